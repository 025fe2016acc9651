"""Fixed values that results depend on.

Everything in this module is a fixed value: the export header layout, the
phrase lists used to classify text, the prompt wording and the default
parameters.  Changing any of them changes results, so they are stated once,
plainly, in their natural order.
"""

# ---- fixed values: export header -------------------------------------------
# Optional invisible marker allowed (at most once) before a header line.
LEADING_MARKERS = ["\u200e", "\u200f", "\ufeff"]  # LRM, RLM, BOM
# Header layout (sample): "[12/7/23, 09:15:50] Name: message"
# date is month/day/two-digit-year, time is 24h with seconds.

# ---- fixed values: text classification -------------------------------------
# Phrases marking non-conversational event messages (case-insensitive,
# matched as whole words anywhere in the text).
SYSTEM_PHRASES = [
    "created group",
    "added",
    "removed",
    "left",
    "joined using this group's invite link",
    "changed this group's icon",
    "changed the group name",
    "changed group settings",
    "changed group description",
    "messages and calls are end-to-end encrypted",
    "you're now an admin",
    "only admins can",
]
# Media placeholders and deleted messages (same matching rules).  The
# deleted-message phrase may be followed by an optional full stop, which
# does not change what matches.
MEDIA_PHRASES = [
    "image omitted",
    "video omitted",
    "audio omitted",
    "sticker omitted",
    "document omitted",
    "GIF omitted",
    "This message was deleted",
]
# Edit marker, removed case-insensitively together with surrounding whitespace.
EDIT_MARKER = "<This message was edited>"
# Speakers excluded by default.
DEFAULT_EXCLUDE_SPEAKERS = ["Meta AI"]

# ---- fixed values: prompt text ---------------------------------------------
DEFAULT_SYSTEM_PROMPT = (
    "You are simulating a friends group chat. Continue naturally with realistic speaker voices, "
    "casual tone, and speaker-tagged lines in the format 'Name: message'."
)
PROMPT_HEADER = "Group chat transcript so far:\n"
TARGET_SPEAKER_PREFIX = "TARGET_SPEAKER="
PROMPT_INSTRUCTION = "Continue the conversation naturally. Keep speaker tags in each line: Name: message"
EMPTY_TRANSCRIPT = "(empty)"
LIVE_LINE_PREFIX = "You: "

# ---- fixed values: chat template (ChatML, the public format of the default
# model family; the model's own template is not part of the inputs) ---------
CHATML_MESSAGE_START = "<|im_start|>"
CHATML_MESSAGE_END = "<|im_end|>\n"
CHATML_GENERATION_PROMPT = "<|im_start|>assistant\n"

# ---- fixed values: default parameters ---------------------------------------
DEFAULT_VAL_RATIO = 0.1
DEFAULT_TEST_RATIO = 0.1
DEFAULT_CHUNK_TURNS = 32
DEFAULT_PROMPT_TURNS = 16
DEFAULT_STRIDE = 8
DEFAULT_MIN_TURNS = 12
DEFAULT_MAX_SEQ_LENGTH = 4096
DEFAULT_TAIL_LINES = 20

# ---- fixed values: character classes (Python str semantics) ----------------
# Characters for which Python's str.isspace() is true (what str.strip() and
# the regex \s remove): U+0009-000D, U+001C-0020, U+0085, U+00A0, U+1680,
# U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WHITESPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
# Line boundaries of Python's str.splitlines(): \n, \r, \r\n, \v, \f,
# U+001C, U+001D, U+001E, U+0085, U+2028, U+2029.
SPLITLINES_CHARS = [0x0A, 0x0D, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]
