"""DuckDB SQL for the derived inputs, as named CTEs (the oracle side of plans/inputs.py).

``with_ctes(body, *names)`` prefixes ``body`` with the named CTEs and every CTE
they depend on, in dependency order.
"""

from __future__ import annotations

_CTES: list[tuple[str, str, tuple[str, ...]]] = [
    ("prompts", """
SELECT label, CAST(prompt_id AS INTEGER) AS prompt_id, vec_id, embedding AS qvec
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS prompt_id
      FROM embeddings) WHERE prompt_id <= 4""", ()),
    ("corpus", """
SELECT vec_id // 6 AS subject_id, vec_id // 3 AS study_id, vec_id AS dicom_id, label, embedding,
       CASE WHEN (vec_id // 6) % 10 = 0 THEN 'test'
            WHEN (vec_id // 6) % 10 BETWEEN 1 AND 3 THEN 'validate' ELSE 'train' END AS split
FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM prompts)""", ("prompts",)),
    ("truth", """
SELECT DISTINCT subject_id, study_id, label, CAST(1.0 AS DOUBLE) AS value FROM corpus""", ("corpus",)),
    ("labelset", "SELECT DISTINCT label FROM prompts", ("prompts",)),
    ("pnorm", """
SELECT label, prompt_id, qvec::DOUBLE[] AS q,
       greatest(sqrt(list_sum(list_transform(qvec::DOUBLE[], lambda x: x * x))), 1e-12) AS nrm
FROM prompts""", ("prompts",)),
    ("pn", """
SELECT label, prompt_id, list_transform(q, lambda x: x / nrm) AS qn FROM pnorm""", ("pnorm",)),
    ("pavg_raw", """
SELECT label, list(x ORDER BY pos) AS a FROM (
  SELECT label, pos, avg(x) AS x FROM (
    SELECT label, generate_subscripts(q, 1) AS pos, unnest(q) AS x FROM pnorm) GROUP BY label, pos)
GROUP BY label""", ("pnorm",)),
    ("pavg", """
SELECT label, list_transform(a, lambda x: x / greatest(sqrt(list_sum(list_transform(a, lambda y: y * y))), 1e-12)) AS an
FROM pavg_raw""", ("pavg_raw",)),
    ("pscore", """
SELECT c.subject_id, c.study_id, c.dicom_id, c.split, p.label, p.prompt_id,
       list_dot_product(c.embedding::DOUBLE[], p.qn) AS s
FROM corpus c CROSS JOIN pn p""", ("corpus", "pn")),
    ("scores_all", """
SELECT subject_id, study_id, dicom_id, split, label, 'cosine_similarity_' || prompt_id AS embedding_type,
       round(s, 5) AS cosine_similarity FROM pscore
UNION ALL
SELECT subject_id, study_id, dicom_id, split, label, 'average_cosine_similarity', round(avg(s), 5)
FROM pscore GROUP BY ALL
UNION ALL
SELECT subject_id, study_id, dicom_id, split, label, 'max_cosine_similarity', round(max(s), 5)
FROM pscore GROUP BY ALL
UNION ALL
SELECT c.subject_id, c.study_id, c.dicom_id, c.split, a.label, 'average_embedding',
       round(list_dot_product(c.embedding::DOUBLE[], a.an), 5)
FROM corpus c CROSS JOIN pavg a""", ("pscore", "pavg", "corpus")),
]

_BY_NAME = {n: (sql, deps) for n, sql, deps in _CTES}


def _closure(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in _BY_NAME[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_ctes(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` the named CTEs (plus dependencies and ``extra`` (name, sql) pairs) then ``body``."""
    order = _closure(names)
    parts = [f"{n} AS ({_BY_NAME[n][0].strip()})" for n in order]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in (extra or [])]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
