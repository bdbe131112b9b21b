"""Label names, codes, thresholds and texts that results depend on."""

# Label names in reporting order.
LABELS = ("entailment", "neutral", "contradiction")
LETTERS = ("E", "N", "C")
UNKNOWN = "unknown"

# Integer classes used by the probes.
CLASS_IDS = {"entailment": 0, "neutral": 1, "contradiction": 2}

# Integer gold codes: the older and the newer convention.
LEGACY_CODES = {-1: "E", 0: "N", 1: "C"}
PREFERRED_CODES = {0: "E", 1: "C", 2: "N"}

# Votes run from -3 to 3; a share of 0.8 counts as agreement; means below 0.5 in size are neutral.
MIN_AGREEMENT = 0.8
NEUTRAL_MEAN = 0.5
LOW_ENTROPY = "low_entropy"
HIGH_ENTROPY = "high_entropy"

# Column names of the item table.
VOTES_COLUMN = "Reponses"
NUMERIC_FEATURES = ("mean.noTarget", "sd.noTarget", "Mean", "SD")
CATEGORICAL_FEATURES = ("Embedding", "factive", "ModalType", "genre", "entropy_class", "Target")
NO_GROUP = "_NOGROUP_"

# Annotation sheet.
SKIPPED = "Skipped"
NO_CHOICE = "None"
CHOICE_SEPARATOR = " | "
ANNOTATION_OPTIONS = (
    "matrix factive verb",
    "matrix non-factive verb",
    "subject of the matrix verb",
    "tense of the predicate",
    "CC is embedded under a question",
    "CC is embedded under a modal verb",
    "CC is embedded under a negation",
    "CC is embedded under a conditional clause",
    "context of the clause",
)

# Prompt text.
PREDICTION_FLAG = "[PREDICTION]:"
PROMPT_INTRO = """You will be given a Context and a Statement. A group of annotators were asked to label the relationship between them using the following criteria:

Assuming the Context is true, the Statement...
* ... is most likely true -> entailment
* ... could be either true or false -> neutral
* ... is most likely false -> contradiction

Your task is to predict the label that most annotators would assign to this item.

Please output only a single label 'E', 'N' or 'C', depending on your prediction, after the flag '[PREDICTION]:'.

"""

# Characters Python's str.strip() removes.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
