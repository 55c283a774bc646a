"""Training and evaluation corpora: formatting, disjoint language subsets, fan-out.

Row identity of a prompt is its *text* where the study uses text (removing a
drawn prompt removes every duplicate of it).  Text equality is tested on a
SHA-256 digest so joins shuffle 64 hex characters instead of whole documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysafe.dims import PROMPT_TEMPLATE, SUBSET_LANGUAGES, LanguageDim
from polysafe.operators import sampling
from polysafe.session import cut_lineage

_PRE, _MID, _POST = PROMPT_TEMPLATE.split("{}")


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def fill_blank(c: Column) -> Column:
    """Null instruction/response -> one space."""
    return F.coalesce(c, F.lit(" "))


def render_prompt(instruction: Column, response: Column) -> Column:
    return F.concat(F.lit(_PRE), fill_blank(instruction), F.lit(_MID), fill_blank(response), F.lit(_POST))


def safety_instruction(data_type: Column, adversarial: Column, vanilla: Column) -> Column:
    """Adversarial prompt when the data type mentions it, else the vanilla one."""
    return F.when(F.coalesce(data_type.contains("adversarial"), F.lit(False)), adversarial).otherwise(vanilla)


def format_safety(df: DataFrame) -> DataFrame:
    """Safety rows -> (text, safety=1, category, instruction, chosen_response)."""
    instr = safety_instruction(F.col("data_type"), F.col("adversarial"), F.col("vanilla"))
    return df.select(
        F.col("prompt_id"),
        render_prompt(instr, F.col("completion")).alias("text"),
        F.lit(1).alias("safety"),
        F.col("data_type").alias("category"),
        instr.alias("instruction"),
        F.col("completion").alias("chosen_response"))


def first_messages(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """First user and first assistant message per conversation (long form).

    ``min(struct(turn, text))`` per role: a partial aggregate, no sort, no
    collect of whole conversations.
    """
    role = F.col("role")

    def first_of(r: str) -> Column:
        return F.min(F.when(role == r, F.struct(F.col("turn"), F.col("text"))))["text"]

    return conversations.groupBy(key).agg(
        first_of("user").alias("instruction"),
        first_of("assistant").alias("chosen_response"),
        first_of("system").alias("system"),
        F.count_if(role == "system").alias("n_system"))


def format_instruction(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Instruction rows -> (text, safety=0, category, instruction, chosen_response)."""
    category = F.when(F.col("n_system") > 0, F.lit("system_prompted")).otherwise(F.lit("open"))
    return pairs.select(
        F.col(key).alias("prompt_id"),
        render_prompt(F.col("instruction"), F.col("chosen_response")).alias("text"),
        F.lit(0).alias("safety"),
        category.alias("category"),
        F.col("instruction"), F.col("chosen_response"))


def instruction_with_input(instruction: Column, inp: Column) -> Column:
    """``instruction + "\\n" + input``; a missing input renders as an empty string."""
    return F.concat(F.coalesce(instruction, F.lit("")), F.lit("\n"), F.coalesce(inp, F.lit("")))


def remove_drawn(df: DataFrame, drawn: DataFrame) -> DataFrame:
    """Left anti join on text: every duplicate of a drawn text goes too."""
    keys = drawn.select(F.col("_tk")).distinct()
    return df.join(keys, "_tk", "left_anti")


def split_subsets(corpus: DataFrame, n_safety: int, fraction: float, key: str = "row_key",
                  subsets: Sequence[Sequence[str]] = SUBSET_LANGUAGES, materialize: bool = True) -> DataFrame:
    """Two disjoint draws (then the rest) tagged with their language subsets.

    Each draw: ``n_safety`` rows per safety category and ``floor(count * fraction)``
    rows per instruction category, quotas fixed from the *first* counts.  After
    each draw every row sharing a drawn text is removed.

    The corpus is read five times by the two draws and anti-joins, so its
    narrow form (key, safety, category, text digest) is checkpointed first:
    texts are hashed once and later stages never recompute the inputs.
    """
    base = corpus.select(key, "safety", "category", text_key(F.col("text")).alias("_tk"))
    if materialize:
        base = cut_lineage(base)
    instr_quota = sampling.group_quota(base.where(F.col("safety") == 0), ["category"], fraction)

    def draw(df: DataFrame) -> DataFrame:
        s = sampling.sample_per_group(df.where(F.col("safety") == 1), ["category"], n_safety, key)
        i = sampling.first_k_by_hash(df.where(F.col("safety") == 0), ["category"], instr_quota, key)
        return s.unionByName(i)

    # each draw is read by the next anti-join and by the result: materialise it
    keep = cut_lineage if materialize else (lambda df: df)
    d1 = keep(draw(base))
    rest1 = remove_drawn(base, d1)
    d2 = keep(draw(rest1))
    rest2 = remove_drawn(rest1, d2)
    arr = lambda langs: F.array(*[F.lit(x) for x in langs])
    out = (d1.withColumn("lg_subset", arr(subsets[0]))
           .unionByName(d2.withColumn("lg_subset", arr(subsets[1])))
           .unionByName(rest2.withColumn("lg_subset", arr(subsets[2]))))
    return out.drop("_tk")


def training_language(lg_subset: Column, lg1: str, lg2: str) -> Column:
    """Language a training row is translated to: lg2 wins over lg1, else English."""
    return (F.when(F.array_contains(lg_subset, lg2), F.lit(lg2))
            .when(F.array_contains(lg_subset, lg1), F.lit(lg1)).otherwise(F.lit("en")))


def fan_out(prompts: DataFrame, dim: LanguageDim) -> DataFrame:
    """Each prompt x each evaluation language, with its category (narrow explode of a literal)."""
    langs = F.array(*[F.struct(F.lit(c).alias("language"), F.lit(cat).alias("language_category"))
                      for c, cat in dim.languages])
    return prompts.select("*", F.explode(langs).alias("_l")).select("*", "_l.*").drop("_l")


def lookup_translations(fanned: DataFrame, store: DataFrame, key: str, text_col: str) -> DataFrame:
    """Reuse stored translations per (key, language); English keeps the source text.

    ``store`` is ``(key, language, translated)``.  Misses stay null for the
    translation step; the join is a plain equi-join (sort-merge or broadcast by AQE).
    """
    j = fanned.join(store, [key, "language"], "left")
    return j.withColumn("prompt", F.when(F.col("language") == "en", F.col(text_col)).otherwise(F.col("translated")))


def pending_keys(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resume: rows of ``wanted`` whose keys are not in ``done`` yet (left anti)."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def complete_harmless(base: DataFrame, pool: DataFrame, n_new: int, dim: LanguageDim, key: str,
                      text_col: str = "prompt") -> DataFrame:
    """Append ``n_new`` harmless prompts not used yet, fanned out to every language."""
    used = base.where((F.col("language") == "en") & (F.col("label") == 0)).select(
        text_key(F.col(text_col)).alias("_tk")).distinct()
    fresh = pool.where(F.col("label") == 0).withColumn("_tk", text_key(F.col(text_col))) \
        .join(used, "_tk", "left_anti").drop("_tk")
    picked = sampling.sample_global(fresh, n_new, key)
    return base.unionByName(fan_out(picked, dim), allowMissingColumns=True)
