"""Word lists, default numbers and text formats whose exact form is part of the result."""

# Word replacements used by augmentation.
SYNONYMS = {
    "good": ["great", "excellent", "fine", "nice", "solid"],
    "bad": ["terrible", "awful", "poor", "dreadful", "lousy"],
    "big": ["large", "huge", "enormous", "massive", "vast"],
    "small": ["tiny", "little", "minor", "slight", "compact"],
    "fast": ["quick", "rapid", "speedy", "swift", "prompt"],
    "slow": ["sluggish", "gradual", "unhurried", "leisurely", "delayed"],
    "happy": ["pleased", "glad", "delighted", "cheerful", "content"],
    "sad": ["unhappy", "upset", "disappointed", "miserable", "down"],
    "like": ["enjoy", "appreciate", "love", "prefer", "fancy"],
    "hate": ["dislike", "detest", "loathe", "despise", "abhor"],
    "buy": ["purchase", "acquire", "get", "obtain", "order"],
    "use": ["utilize", "employ", "apply", "operate", "handle"],
    "make": ["create", "build", "produce", "construct", "develop"],
    "very": ["extremely", "highly", "really", "incredibly", "remarkably"],
    "nice": ["pleasant", "lovely", "wonderful", "enjoyable", "agreeable"],
}

# Filler words used by augmentation.
FILLERS = [
    "actually", "really", "quite", "fairly", "rather",
    "pretty", "somewhat", "definitely", "certainly", "honestly",
]

# Augmentation probabilities.
SYNONYM_PASS, INSERT_PASS = 0.6, 0.4
SYNONYM_WORD, INSERT_WORD = 0.3, 0.15

# Task kinds, name pattern and defaults of a task definition.
TASK_TYPES = ["classification", "extraction", "regression", "scoring", "sequence-labeling"]
TASK_NAME_PATTERN = "^[a-z0-9_-]+$"
SCORE_MIN, SCORE_MAX = 0.0, 5.0
DEFAULT_COUNT, DEFAULT_BATCH = 100, 10
DEFAULT_MODEL = "claude-sonnet-4-20250514"
DEFAULT_INPUT_FIELD, DEFAULT_LABEL_FIELD = "text", "label"
DEFAULT_SPLIT_RATIO = 0.8
DEFAULT_SCRIPT = "scripts/train.py"

# Rows per request.
CONFIDENCE_BATCH, JUDGE_BATCH, ZERO_SHOT_BATCH, EMBED_BATCH = 20, 15, 20, 100

# Request texts. Names in braces are filled from columns.
GENERATE_SYSTEM = (
    "You are a training data generator. Your job is to produce realistic, diverse examples "
    "for a machine learning task.\n\nTask: {description}\nType: {type}"
)
SYSTEM_LABELS = "\nLabels: {labels}"
SYSTEM_FIELDS = "\nFields to extract: {fields}"
SYSTEM_TAGS = (
    "\nEntity types: {labels}\nTag scheme: BIO "
    "(B-TYPE for first token, I-TYPE for continuation, O for outside)"
)
SYSTEM_RANGE = "\nScore range: {lo} to {hi} (numeric, decimals allowed)"

ROW_FORMAT_LABEL = '{"text": "...", "label": "..."}'
ROW_FORMAT_FIELDS = '{"text": "...", "fields": {...}}'
ROW_FORMAT_VALUE = '{"text": "...", "value": <number>}'
ROW_FORMAT_TAGS = '{"tokens": ["word1", "word2", ...], "tags": ["O", "B-TYPE", "I-TYPE", ...]}'

BATCH_HEAD = (
    "Generate exactly {n} training examples as a JSON array.\n"
    "Each example should follow this format: "
)
BATCH_LABELS = "\nDistribute labels roughly evenly across: {labels}"
BATCH_RANGE = (
    '\nEach "value" must be a number between {lo} and {hi}. Distribute scores across the full range '
    "— include low, mid, and high scores. Decimals are encouraged for variety."
)
BATCH_TAGS = (
    "\n\nUse BIO tagging with these entity types: {labels}\n"
    "- B-TYPE marks the first token of an entity\n"
    "- I-TYPE marks continuation tokens\n"
    "- O marks tokens outside any entity\n\n"
    "Include a mix of sentences: some with multiple entities, some with one, some with none.\n"
    "Make the text natural and varied in style and length."
)
BATCH_TAIL = "\n\nContext: {context}\n\nRespond with ONLY a valid JSON array, no other text."

QUALITY_HEAD = (
    "Rate the quality of each training example below.\n\n"
    "For each example, respond with a JSON array of objects: "
    '{"index": N, "score": 0.0-1.0, "reason": "brief reason"}.\n'
    "Score meaning: 1.0 = perfect realistic example, 0.5 = mediocre/ambiguous, "
    "0.0 = wrong/nonsensical.\n\nExamples:\n"
)
QUALITY_TAIL = "\n\nRespond with ONLY the JSON array."
JUDGE_HEAD = (
    "Rate each example on three criteria (0.0-1.0 each):\n"
    "- relevance: Does the text match the task description?\n"
    "- naturalness: Does the text sound like real-world data?\n"
    "- label_correctness: Is the label/annotation accurate?\n\nExamples:\n"
)
JUDGE_TAIL = (
    '\n\nRespond with ONLY a JSON array: [{"index": N, "relevance": 0.0-1.0, '
    '"naturalness": 0.0-1.0, "label_correctness": 0.0-1.0}]'
)
ZERO_SHOT_HEAD = "Classify each text:\n"
ZERO_SHOT_TAIL = (
    "\n\nRespond with ONLY a JSON array of strings (the predicted labels), "
    'e.g. ["label1", "label2", ...]'
)
# System texts of the requests to judge, to rate and to label without examples.
QUALITY_SYSTEM = 'You are a training data quality evaluator for a {type} task: "{description}".'
JUDGE_SYSTEM = 'You are a training data quality evaluator. Rate examples for a {type} task: "{description}".'
ZERO_SHOT_SYSTEM = "You are a classifier. Task: {description}\nLabels: {labels}\nRespond with ONLY a JSON array of labels, one per input."
CONTRAST = (
    'Generate {n} pairs of examples that are easily confused between "{a}" and "{b}".\n\n'
    "For each pair:\n"
    '- One example should be "{a}" but look like it could be "{b}"\n'
    '- One example should be "{b}" but look like it could be "{a}"\n\n'
    "Make them genuinely ambiguous — near the decision boundary.\n\n"
    'Respond with ONLY a JSON array: [{"text": "...", "label": "...", "confused_with": "..."}]'
)
RELABEL_HEAD = (
    "For each example below, assign the correct label from: {labels}\n\n"
    'Respond with a JSON array of objects: {"text": "...", "label": "correct_label"}\n\n'
    "Examples to label:\n"
)
RELABEL_TAIL = "\n\nRespond with ONLY the JSON array."
LABEL_HEAD = "Label these examples with one of: {labels}\n\n"
LABEL_TAIL = '\n\nRespond with ONLY a JSON array: [{"text": "...", "label": "..."}]'
TAG_HEAD = (
    "Tag these token sequences using BIO scheme with entity types: {labels}\n"
    "B-TYPE = first token of entity, I-TYPE = continuation, O = outside.\n\n"
)
TAG_TAIL = '\n\nRespond with ONLY a JSON array: [{"tokens": [...], "tags": [...]}]'
SCORE_HEAD = "Score these texts from {lo} to {hi}:\n\n"
SCORE_TAIL = '\n\nRespond with ONLY a JSON array: [{"text": "...", "value": <number>}]'
