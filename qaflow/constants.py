"""Fixed values that must equal the original service's for identical output.

FIXED VALUES (kept verbatim, in their natural order):

* Redaction tokens, keyed by the kind of private information.
* The account-number pattern (four groups of four digits separated by one space,
  on word boundaries).
* Fallback context texts used when retrieval fails (note the missing space in
  "websiteis" -- it is part of the expected output).
* No-model answer prefixes.
* Prompt template ("basic") and end-of-sequence token.
* Context formats with and without metadata.
* Pipeline stage numbers and metric names.
"""

# --- FIXED VALUES: redaction -------------------------------------------------
REDACTION_TOKENS = {
    "Financial information": "<REDACTED: Financial information>",
    "Persons names": "<REDACTED: Persons names>",
}
ACCOUNT_NUMBER_PATTERN = r"\b\d{4} \d{4} \d{4} \d{4}\b"

# --- FIXED VALUES: retrieval fallbacks ----------------------------------------
NO_DOCUMENTS_PREFIX = "No relevant documents found. Perhaps reframe your query. "
EMBED_ERROR_PREFIX = "Sorry, something went wrong. "
OTHER_ERROR_PREFIX = "Sorry something went wrong. "
FALLBACK_TAIL = "The websiteis an excellent resource for many related questions."

# --- FIXED VALUES: generation -------------------------------------------------
NO_MODEL_REFERENCES_PREFIX = "Xbot is down. Here are some references that may help you:"
NO_MODEL_DOCUMENTS_PREFIX = "Xbot is down. Here are some document excerpts that may help you:"
PROMPT_BASIC = "Given a user query, and context documents, generate a response.\nUSER_QUERY:\n'{user_query}'\nCONTEXT_ITEMS:\n{context}\n"
EOS_TOKEN = "<|endoftext|>"

# --- FIXED VALUES: context formats ---------------------------------------------
CONTEXT_WITH_METADATA = "[title: '{title}', url: '{url}']\n{text}\n"
CONTEXT_PLAIN = "{text}\n"

# --- FIXED VALUES: stages (END is NULL) -----------------------------------------
START, SECURITY, RCACHE, REWRITE, RETRIEVE, RERANK, CONSOLIDATE, GENERATE, WCACHE = (
    -1, 0, 1, 2, 3, 4, 5, 6, 7,
)
END = None
STAGE_NAMES = {
    -1: "START", 0: "SECURITY", 1: "RCACHE", 2: "REWRITE", 3: "RETRIEVE",
    4: "RERANK", 5: "CONSOLIDATE", 6: "GENERATE", 7: "WCACHE",
}
LAST_STAGE = 7

# --- FIXED VALUES: error type names ---------------------------------------------
SECURITY_ERROR = "SecurityServiceError"
EMBED_TIMEOUT_ERROR = "QueryEmbeddingTimeoutError"
NO_DOCUMENTS_ERROR = "NoDcoumentsRetrievedError"
SEARCH_ARGUMENTS_ERROR = "QDRANTArgumentsError"
CONTEXT_WINDOW_ERROR = "AllDocumentsExceedContextWindowError"

# --- FIXED VALUES: metric names, in emission order ------------------------------
METRIC_NAMES = [
    "clean_sensitive_info_seconds",
    "cleaned_request",
    "embed_seconds",
    "user_query_embedding",
    "retrieve_seconds",
    "relevant_document_ids_scores",
    "prompt",
    "query_llm_seconds",
    "response_text",
    "response_token_count",
]

# Payload keys that never count as context metadata.
RESERVED_PAYLOAD_KEYS = ("scores", "doc_id", "text")
# Search options that clash with the search call's own arguments.
RESERVED_SEARCH_KEYS = ("query_vector", "limit", "collection_name")
