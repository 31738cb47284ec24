"""Fixed values that results depend on.

FIXED VALUES (must stay exactly as written, in this order):

* positive prompt templates, ``{label}`` is replaced by the label text:
  "Findings consistent with {label}", "Findings suggesting {label}",
  "Findings are most compatible with {label}", "{label} seen"
* single prompt template: "{label} seen"
* negative prompt templates: "{label} is not seen", "Findings not consistent with {label}",
  "Findings not suggesting {label}", "Findings are not compatible with {label}"
* score measure names: cosine_similarity_1 .. cosine_similarity_4,
  average_embedding, average_cosine_similarity, max_cosine_similarity
* second naming of the measures: query_1 .. query_4, avg_emb, max_cossim
* pooled measures that are evaluated: average_cosine_similarity, max_cosine_similarity
* k sets for precision at k: (5, 10, 20) and (5, 10, 15)
* the 14 finding labels of the first data set, in order:
  Atelectasis, Cardiomegaly, Consolidation, Edema, Enlarged Cardiomediastinum,
  Fracture, Lung Lesion, Lung Opacity, No Finding, Pleural Effusion,
  Pleural Other, Pneumonia, Pneumothorax, Support Devices
* label display replacement: "Enlarged Cardiomediastinum" -> "Enl Card"
* pooling display names of the comparison view:
  average_cosine_similarity_max_accuracy -> "Avg Similarity/Study Max",
  average_cosine_similarity_mean_accuracy -> "Avg Similarity/Study Avg",
  max_cosine_similarity_max_accuracy -> "Max Similarity/Study Max",
  max_cosine_similarity_mean_accuracy -> "Max Similarity/Study Avg"
* skipped pooling methods in the comparison view:
  average_embedding_max_accuracy, average_embedding_mean_accuracy
* threshold of the percent-above report: 0.25
* normalisation epsilon: 1e-12
* number of chunks 6, overlap 5 words
* annotation uid pattern: ``__([\\d\\.]*?)__seg.dcm`` (the dot before dcm is a wildcard)
* run name layout: ``model_run_{i}_{True|False}_{ig|igl}_{tg|tgl}``
"""

from __future__ import annotations

POSITIVE_TEMPLATES = (
    "Findings consistent with {label}",
    "Findings suggesting {label}",
    "Findings are most compatible with {label}",
    "{label} seen",
)
SINGLE_TEMPLATE = ("{label} seen",)
NEGATIVE_TEMPLATES = (
    "{label} is not seen",
    "Findings not consistent with {label}",
    "Findings not suggesting {label}",
    "Findings are not compatible with {label}",
)

PROMPT_MEASURES = ("cosine_similarity_1", "cosine_similarity_2",
                   "cosine_similarity_3", "cosine_similarity_4")
AVG_EMBEDDING = "average_embedding"
AVG_COSINE = "average_cosine_similarity"
MAX_COSINE = "max_cosine_similarity"
ALL_MEASURES = PROMPT_MEASURES + (AVG_EMBEDDING, AVG_COSINE, MAX_COSINE)
POOLED_MEASURES = (AVG_COSINE, MAX_COSINE)

# second data set: prompt i -> query_i, average embedding -> avg_emb, max -> max_cossim
SECOND_NAMING = {
    "cosine_similarity_1": "query_1", "cosine_similarity_2": "query_2",
    "cosine_similarity_3": "query_3", "cosine_similarity_4": "query_4",
    AVG_EMBEDDING: "avg_emb", MAX_COSINE: "max_cossim",
}

K_VALUES = (5, 10, 20)
K_VALUES_PERCENT = (5, 10, 15)

FINDING_LABELS = (
    "Atelectasis", "Cardiomegaly", "Consolidation", "Edema",
    "Enlarged Cardiomediastinum", "Fracture", "Lung Lesion", "Lung Opacity",
    "No Finding", "Pleural Effusion", "Pleural Other", "Pneumonia",
    "Pneumothorax", "Support Devices",
)
LABEL_DISPLAY = {"Enlarged Cardiomediastinum": "Enl Card"}
POOLING_DISPLAY = {
    "average_cosine_similarity_max_accuracy": "Avg Similarity/Study Max",
    "average_cosine_similarity_mean_accuracy": "Avg Similarity/Study Avg",
    "max_cosine_similarity_max_accuracy": "Max Similarity/Study Max",
    "max_cosine_similarity_mean_accuracy": "Max Similarity/Study Avg",
}
SKIPPED_POOLING = ("average_embedding_max_accuracy", "average_embedding_mean_accuracy")

THRESHOLD = 0.25
NORM_EPS = 1e-12
NUM_CHUNKS = 6
OVERLAP_WORDS = 5
UID_PATTERN = r"__([\d\.]*?)__seg.dcm"
RUN_NAME_PATTERN = r"^model_run_(\d+)_(True|False)_(igl?)_(tgl?)$"

# Size bounds for data that is broadcast or collected on the driver.
MAX_PROMPTS_PER_BLOCK = 4096          # prompt vectors broadcast at once
MAX_BROADCAST_ROWS = 1_000_000        # small dimension tables (labels, n per label)
