"""String and projection functions on sentences and role items.

All are built-in Column expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FINAL_PERIOD_PATTERN, NO_UNK_FLAG, UNK_FLAG, UNK_MARK

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def normalise_sentence(text: Column) -> Column:
    """drop trailing blanks plus a final period, then add one period."""
    return F.concat(F.regexp_replace(text, FINAL_PERIOD_PATTERN, ""), F.lit("."))


def sentence_valid(prepared: Column) -> Column:
    """F1 check as a column instead of an assert: ends in ``.`` but not in
    `` .`` (false for a text with a trailing blank and no period)."""
    return prepared.endswith(".") & ~prepared.endswith(" .")


def words(text: Column) -> Column:
    """Whitespace words, empty parts ignored."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """F2."""
    return F.size(words(text))


def strip_final_periods(text: Column) -> Column:
    """every trailing period removed (``str.rstrip('.')``)."""
    return F.regexp_replace(text, r"\.+$", "")


def target_word(text: Column, pos: Column) -> Column:
    """the word at 0-based ``pos``, or the last word for ``pos = -1``,
    without its final periods."""
    w = words(text)
    picked = F.when(pos < 0, F.element_at(w, -1)).otherwise(F.get(w, pos))
    return strip_final_periods(picked)


def corpus_tokens(text: Column) -> Column:
    """Corpus tokeniser: lower case, separators are runs of characters that
    are neither letters nor digits."""
    norm = F.trim(F.regexp_replace(F.lower(text), TOKEN_SPLIT, " "))
    return F.filter(F.split(norm, " "), lambda w: w != "")


def item_string(lemma: Column, pos: Column, role: Column) -> Column:
    """``lemma@pos@role``."""
    return F.concat_ws("@", lemma, pos, role)


def parse_item(s: Column) -> Column:
    """``lemma@pos@role`` -> struct(lemma, pos, role, base_role, key)."""
    p = F.split(s, "@")
    role = F.get(p, 2)
    return F.struct(F.get(p, 0).alias("lemma"), F.get(p, 1).alias("pos"), role.alias("role"),
                    F.substring_index(role, ":", 1).alias("base_role"),
                    F.concat_ws("@", F.get(p, 0), F.get(p, 1)).alias("key"))


def item_lemma(s: Column) -> Column:
    """lemma-only projection."""
    return F.get(F.split(s, "@"), 0)


def strip_role(arg: Column) -> Column:
    """``l@p@r`` -> ``l@p``."""
    return F.regexp_replace(arg, "@[^@]*$", "")


def role_of(arg: Column) -> Column:
    """``l@p@r`` -> ``r``."""
    return F.regexp_extract(arg, "([^@]*)$", 1)


def unk_flag(sentence: Column) -> Column:
    """F10."""
    return F.when(sentence.contains(UNK_MARK), F.lit(UNK_FLAG)).otherwise(F.lit(NO_UNK_FLAG))


def rejoin_tokens(pairs: Column) -> Column:
    """``array<struct<token_id, token>>`` -> blank-joined tokens in
    ``token_id`` order."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["token"]), " ")
