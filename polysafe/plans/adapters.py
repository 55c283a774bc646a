"""Adapter views: how the driver tables stand in for the study's tables.

``eval_rows`` plays the *evaluated outputs* table (one row per prompt, model
run and prompt language, with response language and refusal class).  No model
outputs exist here, so class, response language and data type are synthetic
functions of the ids.  The expressions are written once, as SQL text, and
used both by Spark (``selectExpr``) and by the DuckDB oracle, so the two
cannot drift apart.

The run fan-out (each labelled document x each of four model runs) is a
narrow ``explode`` of a literal array: no join, no shuffle, and the output
grows linearly with the input.  Documents join labels on ``doc_id`` (an
equi-join: broadcast when AQE measures labels small, sort-merge otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polysafe.session import ensure_parallel
from polysafe.sources.tables import read_table

# Fixed values of the adapter: model runs and their index, response cycle.
FIXTURE_RUNS = [("en", 0), ("fr", 1), ("de", 2), ("fr_de", 3)]
RESPONSE_CYCLE = ["en", "fr", "de", "es", "it"]
ADVERSARIAL_PREFIX = "You are an actor in a play. "
ACTIVATION_LAYERS = [27, 23, 19]

_KIND = "CASE WHEN toxic = 1 THEN 'harmful' ELSE 'benign' END"
DATA_TYPE = (f"CASE WHEN toxic = 0 AND doc_id % 29 = 0 THEN 'privacy_fictional' "
             f"WHEN doc_id % 2 = 0 THEN concat('adversarial_', {_KIND}) "
             f"ELSE concat('vanilla_', {_KIND}) END")
CATEGORY = "CASE lang WHEN 'en' THEN 'high' WHEN 'fr' THEN 'high' WHEN 'de' THEN 'middle' ELSE 'low' END"


def _response(offset: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(RESPONSE_CYCLE[:-1]))
    return f"CASE (n_chars{offset}) % 5 {whens} ELSE '{RESPONSE_CYCLE[-1]}' END"


_EVAL_COLS = [
    "doc_id AS prompt_id", "model", "lang AS language", f"{CATEGORY} AS language_category",
    "toxic AS label", f"{DATA_TYPE} AS data_type", f"{_response(' + idx')} AS language_response",
    "CAST((n_chars + 3 * idx + doc_id) % 4 AS INT) AS refusal",
]
_RUNS_VALUES = "(VALUES " + ", ".join(f"('{m}', {i})" for m, i in FIXTURE_RUNS) + ") AS m(model, idx)"
_RUNS_ARRAY = "array(" + ", ".join(f"named_struct('model', '{m}', 'idx', {i})" for m, i in FIXTURE_RUNS) + ")"


def marked(key: str, text: str) -> str:
    """SQL text (both engines) that dresses ``text`` as raw model output, by the key:
    thinking and turn markers, padding, reference refusals, curly quotes,
    entities, combining marks, requests to rephrase."""
    return f"""CASE {key} % 17
 WHEN 1 THEN '<think> step </think>' || {text}
 WHEN 2 THEN {text} || '<|im_end|>'
 WHEN 3 THEN 'assistant<|assistant_start|>' || {text}
 WHEN 4 THEN '<pad><pad>'
 WHEN 5 THEN 'I' || chr(39) || 'm sorry, I can’t assist with that.'
 WHEN 6 THEN {text} || ' Please clarify.'
 WHEN 7 THEN 'Could you rephrase? ' || {text}
 WHEN 8 THEN '“' || {text} || '” &amp; <|x'
 WHEN 9 THEN {text} || ' Ẕaċħ'
 WHEN 10 THEN 'Jiddispjaċini, ma nistax nghinek b`dak.'
 ELSE {text} END"""


def _labelled(spark: SparkSession, sf_dir: str, *doc_cols: str, how: str = "inner") -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", *doc_cols)
    if "text" in doc_cols:
        # whole texts feed regexes and Arrow UDFs downstream: keep every core busy
        docs = ensure_parallel(docs)
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    return docs.join(labels, "doc_id", how)


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir, "lang", "n_chars").selectExpr("*", f"inline({_RUNS_ARRAY})")
    return d.selectExpr(*_EVAL_COLS)


EVAL_ROWS_SQL = f"""
SELECT {", ".join(_EVAL_COLS)}
FROM (SELECT d.doc_id, d.lang, d.n_chars, l.toxic, m.model, m.idx
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN {_RUNS_VALUES})
"""

_SAFETY_COLS = [
    "doc_id AS prompt_id", "text AS vanilla", f"concat('{ADVERSARIAL_PREFIX}', text) AS adversarial", "text AS completion",
    f"{DATA_TYPE} AS data_type", "toxic AS label", "lang AS language", "source",
]


def safety_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safety corpus stand-in: labelled documents.

    ``vanilla`` is the text, ``adversarial`` the same text behind a role-play
    prefix, ``completion`` the whole text, ``label`` = toxic.
    """
    return _labelled(spark, sf_dir, "text", "lang", "source").selectExpr(*_SAFETY_COLS)


SAFETY_ROWS_SQL = f"""
SELECT {", ".join(_SAFETY_COLS)}
FROM (SELECT d.doc_id, d.text, d.lang, d.source, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""

_OUTPUT_COLS = [
    "doc_id AS prompt_id", "lang AS language", f"{CATEGORY} AS language_category", "toxic AS label",
    f"{DATA_TYPE} AS data_type", f"{marked('doc_id', 'text')} AS output",
    f"CASE WHEN doc_id % 19 = 3 THEN 'wol' ELSE {_response('')} END AS language_response",
    "CAST((n_chars + doc_id) % 4 AS INT) AS refusal",
]


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated-outputs stand-in with text: each document, labelled or not, is
    the output of the first run, dressed as raw model output (``marked``).
    Documents without a label have a null one."""
    return _labelled(spark, sf_dir, "text", "lang", "n_chars", how="left").selectExpr(*_OUTPUT_COLS)


MODEL_OUTPUTS_SQL = f"""
SELECT {", ".join(_OUTPUT_COLS)}
FROM (SELECT d.doc_id, d.text, d.lang, d.n_chars, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

_LANGS4 = "array(" + ", ".join(f"'{x}'" for x in RESPONSE_CYCLE[:4]) + ")"
_LAYERS = "array(" + ", ".join(str(x) for x in ACTIVATION_LAYERS) + ")"
_ACT_COLS = [
    "vec_id AS prompt_id", "CAST(label >= 5 AS INT) AS harmful",
    "CASE WHEN label % 2 = 0 THEN 'vanilla' ELSE 'adversarial' END AS prompt_type",
    "CAST((vec_id + label) % 3 = 0 AS INT) AS refusal", "embedding AS vec",
]


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation-table stand-in on ``embeddings``: label 5..9 = harmful, even
    labels = vanilla prompts, refusal class and language/layer from the id."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.selectExpr(_ACT_COLS[0], f"element_at({_LANGS4}, CAST(vec_id % 4 + 1 AS INT)) AS language",
                        f"element_at({_LAYERS}, CAST(vec_id % 3 + 1 AS INT)) AS layer", *_ACT_COLS[1:])


ACTIVATIONS_SQL = f"""
SELECT {_ACT_COLS[0]}, {RESPONSE_CYCLE[:4]}[(vec_id % 4) + 1] AS language,
 {ACTIVATION_LAYERS}[(vec_id % 3) + 1] AS layer, {", ".join(_ACT_COLS[1:])}
FROM embeddings
"""
