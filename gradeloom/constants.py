"""Prompts, messages and limits that results must reproduce exactly."""

# Prompts.
IMAGE_SYSTEM_PROMPT = (
    "You are an expert in converting UML diagram sketches to PlantUML code. "
    "Given an image of a UML diagram, output only the equivalent PlantUML source "
    "wrapped in @startuml / @enduml. "
    "Do not include any explanation, markdown fences, or extra text — "
    "only the raw PlantUML source starting with @startuml."
)
TEXT_SYSTEM_PROMPT = (
    "You are an expert in converting TikZ diagrams to PlantUML code. "
    "Given a TikZ code snippet, output only the equivalent PlantUML source "
    "wrapped in @startuml / @enduml. "
    "Do not include any explanation, markdown fences, or extra text — "
    "only the raw PlantUML source starting with @startuml."
)
TRAINING_SYSTEM_PROMPT = (
    "You are an expert in converting UML diagram sketches to PlantUML code. "
    "Convert this UML sketch into valid PlantUML source code wrapped in @startuml / @enduml."
)
IMAGE_USER_PROMPT = "Convert this UML sketch into valid PlantUML code."
TEXT_USER_PREFIX = "Convert the following TikZ code to valid PlantUML:\n\n"

# Request shape and limits.
REQUEST_URL = "/v1/chat/completions"
IMAGE_URI_PREFIX = "data:image/png;base64,"
REQUEST_FILE_CAP = 150 * 1024 * 1024
TEXT_MAX_TOKENS = 8192
MAX_SEQUENCE_LENGTH = 4096
IGNORED_LABEL = -100

# Messages stored in result rows.
FAILED_CALL_IMAGE = "LLM call failed — see vision_conversion.log"
FAILED_CALL_TEXT = "LLM call failed — see log"
FAILED_IN_BATCH = "LLM failure in batch"
FAILED_IN_BENCHMARK = "LLM failure"
EMPTY_RESPONSE = "Empty response"
MISSING_START = "Missing @startuml"
MISSING_END = "Missing @enduml"
EMPTY_BODY = "Empty diagram body"
PREFLIGHT_MISSING_START = "Missing @startuml directive (pre-flight check)"
PREFLIGHT_MISSING_END = "Missing @enduml directive (pre-flight check)"
RENDER_REJECTED = (
    "PlantUML server rejected the diagram (HTTP 400) — syntax error in UML source"
)
RENDER_HTTP_ERROR = "PlantUML server returned HTTP "
RENDER_CONTENT_TYPE = "Server returned unexpected content-type: "
RENDER_REPORTED = "PlantUML server reported: "

# Places and words that mark an error image.
ERROR_CHUNK_KEYS = ("plantuml", "error", "Error")
ERROR_WORDS = ("error", "syntax", "unexpected", "cannot", "unknown")
ERROR_MARKERS = ("Syntax Error", "Error", "cannot parse", "Unexpected token")

# Model labels and metric columns, in report order.
BASE = "base"
FINETUNED = "finetuned"
METRICS = (
    "exact_match", "bleu", "codebleu", "emb_sim",
    "token_prec", "token_recall", "token_f1",
)
THRESHOLD_METRICS = ("codebleu", "bleu", "token_f1", "emb_sim")
DEFAULT_THRESHOLD = 0.5
