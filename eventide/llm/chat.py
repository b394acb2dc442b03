"""Chat formatting with DataFrame functions only.

One row per conversation: turn structs are collected and sorted, adjacent
turns of a role are merged into a run by array functions, and the runs are
concatenated::

    <|start|>role<|message|>text(<|part|>text)*<|end|> ...

The texts of a run stay apart by ``<|part|>``, so the turns can be read back.
Control strings inside a role or text (the template's own and those of other
common templates) are escaped by a backslash after their first character, and
one that already has backslashes there gets one more; undoing removes one.
``loss`` lists the spans (start, end; code points of ``formatted``) of the
assistant's texts: markers and other roles are not trained on.

Edge cases: null text and null role count as empty; turns are sorted by (turn, role,
text), nulls first, so ties and repeated rows have one order and all stay; a
null ``conv_id`` is a conversation of its own; other columns are ignored; an
empty table gives an empty result.  A conversation is one value of the result,
so its turns meet in one group; they are shuffled once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import once


@dataclass(frozen=True)
class Template:
    start: str = "<|start|>"
    message: str = "<|message|>"
    part: str = "<|part|>"
    end: str = "<|end|>"
    # control strings of other templates that may not appear inside texts
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
                                 "<|endoftext|>")
    trained: tuple[str, ...] = field(default=("assistant",))

    @property
    def controls(self) -> tuple[str, ...]:
        return self.start, self.message, self.part, self.end, *self.reserved

    def _patterns(self):
        """For each first character: the rest of the controls it begins."""
        for first in sorted({c[0] for c in self.controls}):
            rest = "|".join(re.escape(c[1:]) for c in sorted(self.controls, reverse=True) if c[0] == first)
            yield re.escape(first), rest

    def escape(self, text: Column) -> Column:
        for first, rest in self._patterns():
            text = F.regexp_replace(text, F.lit(rf"({first})(\\*)({rest})"), F.lit(r"$1\\$2$3"))
        return text

    def unescape(self, text: Column) -> Column:
        for first, rest in self._patterns():
            text = F.regexp_replace(text, F.lit(rf"({first})\\(\\*)({rest})"), F.lit("$1$2$3"))
        return text


TEMPLATE = Template()


def format_conversations(turns: DataFrame, template: Template = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, loss)`` of each conversation."""
    t = template
    rows = turns.select(F.col(f"`{id_col}`").alias("conv_id"), F.struct(
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # places (from 1) at which a run of one role starts
    first_of_run = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (
        F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    runs = once(first_of_run, lambda starts: F.transform(starts, lambda s, k: F.struct(
        F.element_at("turns", s)["role"].alias("role"),
        F.transform(F.slice("turns", s, F.coalesce(F.get(starts, k + 1), F.size("turns") + 1) - s),
                    lambda x: t.escape(x["text"])).alias("parts"))))
    merged = sorted_turns.select("conv_id", runs.alias("runs"))
    pieces = merged.select("conv_id", F.transform("runs", lambda r: F.struct(
        F.concat(F.lit(t.start), t.escape(r["role"]), F.lit(t.message)).alias("head"), r["parts"].alias("parts"),
        r["role"].isin(*t.trained).alias("trained"))).alias("runs"))
    formatted = F.array_join(F.transform("runs", lambda r: F.concat(
        r["head"], F.array_join(r["parts"], t.part), F.lit(t.end))), "")
    # walk the runs with the place in the output and the spans so far
    spans = "array<struct<start:int,end:int>>"
    walk = F.aggregate("runs", F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("loss")), lambda acc, r: F.struct(
        (acc["at"] + F.char_length(r["head"]) + F.char_length(F.array_join(r["parts"], t.part)) + len(t.end)).alias("at"),
        F.when(r["trained"], F.concat(acc["loss"], F.aggregate(
            r["parts"], F.struct((acc["at"] + F.char_length(r["head"])).alias("at"), F.array().cast(spans).alias("loss")),
            lambda a, p: F.struct((a["at"] + F.char_length(p) + len(t.part)).alias("at"), F.concat(a["loss"], F.array(F.struct(
                a["at"].alias("start"), (a["at"] + F.char_length(p)).alias("end")))).alias("loss")))["loss"]))
        .otherwise(acc["loss"]).alias("loss")))
    return pieces.select("conv_id", formatted.alias("formatted"), walk["loss"].alias("loss"))


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``(conv_id, turns, loss_text, formatted)``: the (role, text) turns parsed
    from ``formatted`` and the unescaped text under the loss mask."""
    t = template
    runs = F.transform(F.filter(F.split("formatted", re.escape(t.end)), lambda r: r != ""),
                       lambda r: F.split(F.substring(r, len(t.start) + 1, 2**31 - 1), re.escape(t.message), 2))
    turns = F.flatten(F.transform(runs, lambda r: F.transform(F.split(F.get(r, F.lit(1)), re.escape(t.part)), lambda p: F.struct(
        t.unescape(F.get(r, F.lit(0))).alias("role"), t.unescape(p).alias("text")))))
    under = once(F.col("formatted"), lambda f: F.array_join(F.transform("loss", lambda s: t.unescape(
        F.substring(f, s["start"] + 1, s["end"] - s["start"]))), ""))
    return formatted.select("conv_id", turns.alias("turns"), under.alias("loss_text"), "formatted")


def report(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of what :func:`read_back` finds."""
    back = read_back(formatted, template)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))
