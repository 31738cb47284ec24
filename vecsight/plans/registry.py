"""All query keys: ``queries()`` (Spark) and ``oracle_sql()`` (DuckDB twins)."""

from __future__ import annotations

from vecsight.plans import q_analytics, q_data, q_notes, q_pipelines, q_retrieval, q_tables

_MODULES = (q_retrieval, q_data, q_tables, q_notes, q_analytics, q_pipelines)


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def _unsigned_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB rounds tiny negatives to
    -0.0 where Spark gives 0.0; adding a double zero makes both +0.0."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, quote = 0, j + 5, False
        while k < len(sql):
            ch = sql[k]
            if ch == "'":
                quote = not quote
            elif not quote and ch == "(":
                depth += 1
            elif not quote and ch == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _unsigned_zero_rounds(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + CAST(0 AS DOUBLE))")
        i = k + 1


def oracle_sql() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.SQL)
    return {k: _unsigned_zero_rounds(v) for k, v in out.items()}
