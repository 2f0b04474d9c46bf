"""Review actions and issue states."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulemill.functions.text import EMPTY_WORDS, is_empty_word, strip

# Words for the two actions.
APPROVE_WORDS = ("approve", "approved", "apply", "yes", "y")
REJECT_WORDS = ("reject", "rejected", "skip", "no", "n")
# Words for each issue state; the last word of each row is the state itself.
STATUS_WORDS = {
    "pending_review": (*EMPTY_WORDS, "pending", "pending_review"),
    "approved": ("approve", "approved"),
    "rejected": ("reject", "rejected"),
    "applied": ("apply", "applied"),
    "revalidated_resolved": ("resolved", "revalidated_resolved"),
    "revalidated_remaining": ("remaining", "revalidated_remaining"),
}
STATUSES = tuple(STATUS_WORDS)
FINAL_STATUSES = ("applied", "revalidated_resolved", "revalidated_remaining")


def _word(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def _meaning(word: Column, meanings: Mapping[str, Sequence[str]]) -> Column:
    """The meaning that lists the word, or null. A constant map names the word once, however many words there are."""
    pairs = [F.lit(x) for meaning, words in meanings.items() for w in words for x in (w, meaning)]
    return F.try_element_at(F.create_map(*pairs), word)


def normalize_user_action(c: Column) -> Column:
    return action_of_word(_word(c))


def action_of_word(word: Column) -> Column:
    """The action that a stripped word in lower case stands for; other words stay."""
    return F.coalesce(_meaning(word, {"approve": APPROVE_WORDS, "reject": REJECT_WORDS, "": EMPTY_WORDS}), word)


def normalize_issue_status(c: Column) -> Column:
    word = _word(c)
    return F.coalesce(_meaning(word, STATUS_WORDS), word)


def is_valid_issue_status(c: Column) -> Column:
    return normalize_issue_status(c).isin(*STATUSES)


def derive_issue_status(stored: Column, action: Column) -> Column:
    return state_of_words(_word(stored), _word(action))


def state_of_words(stored: Column, action: Column) -> Column:
    """derive_issue_status of stripped words in lower case."""
    return F.coalesce(
        _meaning(stored, {s: STATUS_WORDS[s] for s in FINAL_STATUSES}),
        _meaning(action, {"approved": APPROVE_WORDS, "rejected": REJECT_WORDS}),
        _meaning(stored, STATUS_WORDS), F.lit("pending_review"))


def strip_fix_id(c: Column) -> Column:
    """The part of a fix cell before the first bar."""
    return strip(F.split_part(c, F.lit("|"), F.lit(1)))


def fix_id_of_text(text: Column) -> Column:
    """strip_fix_id of a stripped cell, empty for a word that stands for an empty one; most cells have no bar."""
    return (
        F.when(text.contains("|"), strip(F.substring_index(text, "|", 1)))
        .when(is_empty_word(text), F.lit("")).otherwise(text))
