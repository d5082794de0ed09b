"""Scalar text functions as Column expressions; all stay in whole-stage codegen.

Patterns carry the prefix (?sdU): dot matches line ends, only LF ends a line, and \\w, \\W, \\s are Unicode's.
A null argument gives null unless said otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section headers of a rendered answer, the answer wordings, and the option letters.
FINAL_HEADER = "## Final Response\n\n"
THINKING_HEADER = "## Thinking\n\n"
LETTERS = "ABCDEFGHIJKLMN"
STRICT = r"(?sdU)(answer is\s*?)([A-N])"
FREE_LEFT = r"""([\x{4e00}-\x{9fff}]|is |\W|^|#)"""
FREE_RIGHT = r"(\W|[\x{4e00}-\x{9fff}]|$)"


def options_text(options: Column) -> Column:
    """Options (array of label, text) as lines `label. text`, in their order."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["label"], F.lit(". "), o["text"])), "\n")


def question_block(question: Column, options: Column) -> Column:
    """The question, a line break and its options; null if either is."""
    return F.concat(question, F.lit("\n"), options_text(options))


def fill(template: str, **slots: Column) -> Column:
    """The template with each {name} replaced by a column. Braces in the columns are plain text; {{ and }} are braces."""
    parts: list[Column] = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{(\w+)\}", template):
        parts.append(slots[name] if name else F.lit(literal.replace("{{", "{").replace("}}", "}")))
    return F.concat(*parts)


def last_section(text: Column, header: str = FINAL_HEADER) -> Column:
    """What follows the last header; the whole text if there is none."""
    return F.substring_index(text, header, -1)


def count_of(text: Column, part: str) -> Column:
    """Occurrences of part that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def strip(text: Column) -> Column:
    """Without white space, as Unicode has it, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def keep_limit(text: Column, ids: Column, most: int, decode) -> Column:
    """The text of the first `most` tokens (ids, decode(ids)) where there are more, else its last `most` characters; 0 is no limit."""
    return text if not most else F.when(F.size(ids) > most, decode(F.slice(ids, 1, most))).otherwise(F.right(text, F.lit(most)))


def has_answer_format(text: Column) -> Column:
    """Exactly one final and one thinking header."""
    return (count_of(text, FINAL_HEADER) == 1) & (count_of(text, "## Thinking") == 1)


def final_section(text: Column) -> Column:
    """What follows the first final header, stripped; the empty text if there is none."""
    return strip(F.regexp_extract(text, rf"(?s){FINAL_HEADER}(.*)", 1))


def bracket_content(text: Column) -> Column:
    """From the first { to the last }; null if there is no such pair."""
    out = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(out != "", out)


def json_body(text: Column) -> Column:
    """What a JSON parser is given of a model's answer: the bracket content unless it starts with {, without line feeds."""
    return F.replace(F.when(F.startswith(text, F.lit("{")), text).otherwise(bracket_content(text)), F.lit("\n"), F.lit(""))


def passes(response: Column) -> Column:
    """Whether a filter's answer lets the item pass: it contains `pass`, in any case."""
    return F.contains(F.lower(response), F.lit("pass"))


def verdict(response: Column) -> Column:
    """Whether a judge's answer is positive: it contains `true`, in any case."""
    return F.contains(F.lower(response), F.lit("true"))


def postprocess(prediction: Column) -> Column:
    """A raw prediction without end marks and without one leading blank."""
    return F.regexp_replace(F.replace(prediction, F.lit("</s>"), F.lit("")), "^ ", "")


def contains_answer(prediction: Column, gold: Column) -> Column:
    """Whether any of the gold texts stands in the lower-cased prediction as a whole token."""
    p = F.lower(prediction)
    return F.coalesce(F.exists(gold, lambda g: F.regexp_like(p, F.concat(F.lit(r"(?sdU)(\W|^)\Q"), F.replace(g, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(\W|$)")))), F.lit(False))


def keep_tail(text: Column, n: int) -> Column:
    """The last n characters of a longer text (n <= 0: all)."""
    return text if n <= 0 else F.when(F.length(text) > n, F.right(text, F.lit(n))).otherwise(text)


# --- steps (array of action, title, content, has_title) --------------------------------------------------


def stream_of_search(steps: Column) -> Column:
    """Steps as text: each under a ### head, its title where the step has that key, else its action."""
    action = lambda s: F.replace(s["action"], F.lit("Final Conclusion"), F.lit("Conclusion"))
    head = lambda s: F.when(s["has_title"], s["title"]).otherwise(action(s))
    return strip(F.array_join(F.transform(steps, lambda s: F.concat(F.lit("### "), head(s), F.lit("\n"), s["content"], F.lit("\n"))), "\n"))


def final_conclusion(steps: Column) -> Column:
    """Content of the second-last step; null for fewer than two."""
    return F.try_element_at(steps, F.lit(-2))["content"]


def without_last(steps: Column) -> Column:
    """The steps but the last."""
    return F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0)))


def continued(steps: Column, more: Column) -> Column:
    """Steps with the last one replaced by further ones."""
    return F.concat(without_last(steps), more)


def json_text(value: Column) -> Column:
    """A text as a JSON string, other letters than ASCII as they are; null as null."""
    whole = F.to_json(F.struct(value.alias("v")))  # {"v":"..."}
    return F.when(value.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def steps_json(steps: Column) -> Column:
    """The steps without the last as JSON, indented by two. A title that a step does not have is left out; what it has as null is null."""
    line = lambda k, v: F.concat(F.lit(f'    "{k}": '), json_text(v))
    title = lambda s: F.when(s["has_title"], line("title", s["title"]))
    one = lambda s: F.concat(F.lit("  {\n"), F.concat_ws(",\n", line("action", s["action"]), title(s), line("content", s["content"])), F.lit("\n  }"))
    kept = without_last(steps)
    return F.when(F.size(kept) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(kept, one), ",\n"), F.lit("\n]")))


def valid_steps(steps: Column) -> Column:
    """Whether there are three or more and the last are an inner thinking, the final conclusion and a verification."""
    act = lambda k: F.try_element_at(steps, F.lit(k))["action"]
    return F.coalesce((F.size(steps) >= 3) & (act(-3) == "Inner Thinking") & (act(-2) == "Final Conclusion") & (act(-1) == "Verification"), F.lit(False))


# --- rendering (fixed values: the role marks of the chat format) -------------------------------------------


def sft_target(cot: Column, response: Column) -> Column:
    """The answer a model is to learn: thinking, then the final response, under their headers."""
    return F.concat(F.lit(THINKING_HEADER), cot, F.lit("\n\n" + FINAL_HEADER), response)


def chat(messages: list[tuple[str, Column]], bos: str = "<|begin_of_text|>", ask: bool = False) -> Column:
    """Messages under role headers, contents trimmed, bos before the first; with ask, an assistant header at the end."""
    parts: list[Column] = [F.lit(bos)]
    for role, content in messages:
        parts += [F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n"), strip(content), F.lit("<|eot_id|>")]
    return F.concat(*parts, *([F.lit("<|start_header_id|>assistant<|end_header_id|>\n\n")] if ask else []))


def chat_array(messages: Column, bos: str = "<|begin_of_text|>", ask: bool = False) -> Column:
    """As chat, for a column of messages (array of role, content)."""
    one = lambda m: F.concat(F.lit("<|start_header_id|>"), m["role"], F.lit("<|end_header_id|>\n\n"), strip(m["content"]), F.lit("<|eot_id|>"))
    tail = F.lit("<|start_header_id|>assistant<|end_header_id|>\n\n" if ask else "")
    return F.concat(F.lit(bos), F.array_join(F.transform(messages, one), ""), tail)
