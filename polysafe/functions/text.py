"""Text column functions: output clean-up, normalisation, code parsing.

Everything that Spark's built-ins can express is a plain Column expression
(stays in whole-stage codegen).  Only HTML entity decoding and Unicode NFC
have no built-in; they run in one Arrow-batched pandas UDF (``normalize_text``).
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from polysafe.dims import ISO_CODES, ARABIC_DIALECTS

# ---------------------------------------------------------------------------
# Markers of model outputs.
# Split happens *before* these (the last two only inside literal quotes).
SPLIT_BEFORE = r'(?=</think>|<think>|<\|user_end\|>|<\|assistant_start\|>|"<end_of_turn>"|"<\|im_end\|>")'
# Segments equal to one of these (after stripping) are skipped.
SKIP_SEGMENTS = ["</think>", "<think>", "assistant", "user", ".", ",", "!", "?", ";", ":",
                 "<|im_end|>", "<|im_start|>", "<end_of_turn>", "<pad>", "<|vision_pad|>",
                 "<|user_end|>", "<|assistant_start|>"]
# Deleted from the chosen segment, one after the other in this order.
DELETE_MARKERS = ["</think>", "<think>", "<|im_end|>", "<|im_start|>", "<end_of_turn>", "<pad>",
                  "<|vision_pad|>", "<|user_end|>", "<|assistant_start|>"]
# Answers mentioning these words are not counted as refusals (case-sensitive).
REPHRASE_PATTERN = "rephrase|clarify"
# ---------------------------------------------------------------------------

# Characters Python's str.strip() removes: Unicode White_Space plus the four
# ASCII separators 0x1c-0x1f (the full set of str.isspace() characters).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
                 + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c: Column) -> Column:
    """``str.strip()`` semantics (``trim`` without characters only removes spaces)."""
    return F.trim(c, F.lit(PY_WHITESPACE))


def delete_markers(c: Column) -> Column:
    for m in DELETE_MARKERS:
        c = F.replace(c, F.lit(m), F.lit(""))
    return c


def first_segment(text: Column) -> Column:
    """First useful segment of a model output; none (or null input) -> one space.

    Each segment is stripped once (kept next to the original, from which the
    markers are then deleted).
    """
    segs = F.transform(F.split(text, SPLIT_BEFORE), lambda s: F.struct(s.alias("raw"), py_strip(s).alias("stripped")))
    skip = F.array(*[F.lit(s) for s in SKIP_SEGMENTS])
    useful = F.filter(segs, lambda s: (F.length(s["stripped"]) > 0) & ~F.array_contains(skip, s["stripped"]))
    chosen = F.get(useful, 0)["raw"]
    return F.coalesce(py_strip(delete_markers(chosen)), F.lit(" "))


# Quote and Maltese-letter folding, applied in this order.
_FOLD = [("‘", "'"), ("’", "'"), ("`", "'"), ("“", '"'), ("”", '"'), ("ċ", "c"), ("ħ", "h")]
# Combining marks (category Mn) all lie at or above U+0300.
_ABOVE_LATIN = re.compile("[\u0300-\U0010ffff]")


def _normalize_one(text) -> str:
    t = str(text)
    if "&" in t:
        t = html.unescape(t)
    t = t.replace("<|", "")
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
        if _ABOVE_LATIN.search(t):
            for c in {c for c in set(t) if c >= "\u0300" and unicodedata.category(c) == "Mn"}:
                t = t.replace(c, "")
    for a, b in _FOLD:
        t = t.replace(a, b)
    return t if t.isascii() else unicodedata.normalize("NFC", t)


def normalize_py(text) -> str | None:
    return None if text is None else _normalize_one(text)


@pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """Exact-match normalisation: entities decoded, ``<|`` removed, NFC, no
    combining marks, straight quotes, Maltese dotted/barred letters folded."""
    return texts.map(normalize_py, na_action="ignore")


@pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def iso_code(detector_label: Column, fallback: Column | None = None) -> Column:
    """Detector label (``xxx_Script``) -> ISO 639-1; ``zh-cn`` -> ``zh``; Arabic
    dialects -> ``ar``; unknown codes pass through; null -> ``fallback``, folded likewise."""
    prefix = F.split_part(detector_label, F.lit("_"), F.lit(1))
    mapping = F.create_map(*[x for k, v in ISO_CODES.items() for x in (F.lit(k), F.lit(v))])
    iso = F.coalesce(F.try_element_at(mapping, prefix), prefix)
    if fallback is not None:
        iso = F.coalesce(iso, fallback)
    return F.when(iso == "zh-cn", F.lit("zh")).when(iso.isin(ARABIC_DIALECTS), F.lit("ar")).otherwise(iso)


def class_from_label(label: Column) -> Column:
    """``..._2`` -> 2; anything unparsable -> 0."""
    return F.coalesce(F.try_element_at(F.split(label, "_"), F.lit(-1)).try_cast("int"), F.lit(0))


def checkpoint_number(name: Column) -> Column:
    """``checkpoint-3988.csv`` -> ``3988``."""
    return F.regexp_replace(F.element_at(F.split(name, "-"), -1), r"\.csv$", "")


def run_name(model: Column, data: Column, training: Column, lr: Column) -> Column:
    return F.format_string("%s-Base_%s_%s_%s", model, data, training, lr)


def json_value(json_string: Column, key: str) -> Column:
    return F.get_json_object(json_string, f"$.{key}")


def contains_rephrase(text: Column) -> Column:
    return F.coalesce(text.rlike(REPHRASE_PATTERN), F.lit(False))


def generated_ids(ids: Column, prompt_len: Column, drop_token: int) -> Column:
    """Generated part of a token-id array (after the prompt) without one token id."""
    return F.array_remove(F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0))), drop_token)
