"""Values shared by the whole package.

Fixed values: these must equal the reference's for matching results.
"""

# --- fixed values -----------------------------------------------------------
# thematic-fit operation labels, in the order the policy tests them
OP_NO_FILLERS = "no_fillers"
OP_ONE_LIST = "one_filler_list"
OP_UPDATE = "update"
OP_FALLBACK = "intersection_empty_get_verbfillers"
# thematic-fit defaults: list length N, centroid size M, weight and update functions
TF_LIST_LENGTH = 200
TF_CENTROID_SIZE = 20
TF_WEIGHT = "lmi"
TF_UPDATE = "prod"
# corpus minimum frequencies and the pair window
TRIPLE_MIN_FREQ = 2
PAIR_MIN_FREQ = 5
PAIR_WINDOW = 10
LEMMA_MIN_FREQ = 50
# minimum frequency of a lemma with its part of speech in the thematic-fit lists
LEMMA_POS_MIN_FREQ = 60
# prefix by which pieces are grouped into words, prefix that the piece cutter
# writes, byte-level word-start marker, special tokens
CONT_PREFIX = "#"
PIECE_PREFIX = "##"
WORD_MARKER = "Ġ"
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "<s>", "</s>")
# unknown-word marker in surprisal tokens and the report flags
UNK_MARK = "UNK"
UNK_FLAG, NO_UNK_FLAG = "unk", "nounk"
# sentence preparation: trailing blanks plus one final period are replaced by "."
FINAL_PERIOD_PATTERN = r"\s*\.$"
# explain-log line per component, item flags, prototype filler format
PPMI_LOG_FORMAT = "%s-%s-%s freq:%s ppmi:%s"
ZERO_SCORE_FLAG, SCORE_FLAG = "zero_score", "score"
FILLER_FORMAT = "%s (%s)"
# --- end of fixed values ----------------------------------------------------
