"""Parameters of the registered queries, shared by the Spark side and the oracle."""

from narrascope.plans.fixtures import (  # noqa: F401  (re-exported fixed values)
    EPOCH, GAZ_FIRST, GAZ_GROUPS, GAZ_LAST, MINUTES_PER_DOC, NAME_PAIRS, STOP_LAST, URL_PREFIX, VOCAB_TOP,
)
from narrascope.operators.entities import GAZETTEER_METHOD, NER_MAX_CHARS  # noqa: F401

# Mentions whose surface form has at least this many characters are stored
# as word pieces (prefixed ``##``), as a sub-word tagger would emit them.
SUBWORD_MIN_LEN = 9
# Second sentiment method (title only), so that trends count joined rows.
TITLE_METHOD = "inset_title"

# Date range of the network, trend and phrase queries; the end is a bare
# date, so it means midnight.
RANGE_START = "2024-01-01T06:00:00"
RANGE_END = "2099-12-31"
# Range of the Q1 key.
Q1_START = "2024-01-02T10:00:00"
Q1_END = "2024-01-20"
# Network filters of the Q5/Q7 keys (the UI defaults).
MIN_SCORE = 0.5
MAX_SCORE = 1.0
GROUPS = ("PER", "ORG", "NOR", "LAW", "EVT")
PAGE = 1
PAGE_ROWS = 10

# Language kept by the cleaning stage, and the first-n limit of S6.
TARGET_LANG = "en"
LIMIT_N = 100

# Storage keys: the table at rest is written by run 1, the incoming rows by run 2.
RUN1, RUN1_DATE = "run-1", "2024-01-01"
RUN2, RUN2_DATE = "run-2", "2024-02-01"
INCOMING_SOURCE = "feed-b"
RERUN_METHOD = "gazetteer-v2"
RERUN_LANG = "en"
RERUN_MIN_WORD = 6
ERROR_REPEAT = 4
RECENT_N = 5
RETITLE = "Update: "
