"""Chat message arrays and chat-template rendering as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polysafe.functions.text import PY_WHITESPACE

# ---------------------------------------------------------------------------
# Chat templates of the two model families (kept verbatim,
# including the stray quote after the empty think block of the second family).
GEMMA_TEMPLATE = "<start_of_turn>user\n{instruction}<end_of_turn>\n<start_of_turn>model\n"
QWEN_TEMPLATE = "<|im_start|>user\n{instruction}<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n'\n"
QWEN_TEMPLATE_WITH_SYSTEM = ("<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{instruction}<|im_end|>\n"
                             "<|im_start|>assistant\n<think>\n\n</think>\n\n'\n")
TRANSLATION_SYSTEM_PROMPT = ("You are a translation chatbot. Translate the input into English. You should not "
                             "generate any content other than the pure translation of the input. Repeat the "
                             "user's input if you can't translate.")
# ---------------------------------------------------------------------------


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_chat(prompt: Column) -> Column:
    return F.array(message("user", prompt))


def training_chat(instruction: Column, response: Column) -> Column:
    blank = F.lit(" ")
    return F.array(message("user", F.coalesce(instruction, blank)), message("assistant", F.coalesce(response, blank)))


def translation_chat(text: Column) -> Column:
    return F.array(message("system", F.lit(TRANSLATION_SYSTEM_PROMPT)), message("user", text))


def _fill(template: str, **cols: Column) -> Column:
    """Template text with ``{name}`` slots -> concat of literals and columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            parts.append(F.lit(pre))
        parts.append(cols[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def render_chat(family: str, instruction: Column, system: Column | None = None, output: Column | None = None,
                trailing_whitespace: bool = True) -> Column:
    """Render one instruction with a family's template.

    The first family has no system slot: a non-null system text raises when
    the row is evaluated.
    """
    if family == "gemma":
        text = _fill(GEMMA_TEMPLATE, instruction=instruction)
        if system is not None:
            text = F.when(system.isNotNull(), F.raise_error(F.lit("System prompts are not supported"))
                          .cast("string")).otherwise(text)
    elif family == "qwen":
        plain = _fill(QWEN_TEMPLATE, instruction=instruction)
        text = plain if system is None else F.when(
            system.isNotNull(), _fill(QWEN_TEMPLATE_WITH_SYSTEM, instruction=instruction, system=system)
        ).otherwise(plain)
    else:
        raise ValueError(f"unknown template family {family!r}")
    if not trailing_whitespace:
        text = F.rtrim(text, F.lit(PY_WHITESPACE))
    if output is not None:
        text = F.concat(text, output)
    return text
