"""Token assembly of conversations: ids, loss masks, attention masks and positions, as built-in expressions.

A tokenizer is a function from a text column to an array of ids; ``character_ids`` is the
plain one, one id per character. A template puts a message's header before its ids and an
end behind them. One row is one conversation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions import arrays as A

Tokenizer = Callable[[Column], Column]


def character_ids(text: Column) -> Column:
    """One id per character, its code point."""
    return F.transform(F.filter(F.split(text, "", -1), lambda c: c != ""), lambda c: F.ascii(c))


@dataclass(frozen=True)
class Template:
    """Ids around messages: ``begin`` + role + ``after_role`` before the content, ``end`` behind it.

    system: a system prompt that the template puts before a conversation without one.
    """

    begin: tuple[int, ...] = (1,)
    after_role: tuple[int, ...] = (2,)
    end: tuple[int, ...] = (3,)
    roles: tuple[tuple[str, int], ...] = (("system", 11), ("user", 12), ("assistant", 13), ("tool", 14))
    system: str = ""

    def header(self, role: Column) -> Column:
        kind = F.lit(0)
        for name, i in self.roles:
            kind = F.when(role == name, i).otherwise(kind)
        return F.concat(F.array(*map(F.lit, self.begin)), F.array(kind), F.array(*map(F.lit, self.after_role)))

    @property
    def header_size(self) -> int:
        return len(self.begin) + 1 + len(self.after_role)


def message(role: Column, content: Column, template: Template, tokenizer: Tokenizer) -> Column:
    """Struct ids and loss of one message: assistants' own ids and end count, their header (the generation prompt) does not."""
    ids = F.concat(template.header(role), tokenizer(content), F.array(*map(F.lit, template.end)))
    return A.let(ids, lambda x: F.struct(x.alias("ids"), F.transform(x, lambda _, i: F.when((role == "assistant") & (i >= template.header_size), 1).otherwise(0)).alias("loss")))


def assembled(turns: Column, template: Template, tokenizer: Tokenizer, max_length: int | None = None, pad: int = 0, side: str = "right") -> Column:
    """Struct ids, loss, attention and positions of a conversation (array of structs role, content, in order).

    A system message later than the first is dropped where it repeats the one before. With max_length, longer ones
    are truncated (side: right, left or error), shorter ones padded.
    """
    kept = F.filter(turns, lambda t, i: (i == 0) | (t["role"] != "system") | ~t["content"].eqNullSafe(turns[0]["content"]))
    if template.system:
        first = F.array(F.struct(F.lit("system").alias("role"), F.lit(template.system).alias("content")))
        kept = F.when((F.size(turns) > 0) & (turns[0]["role"] != "system"), F.concat(first, kept)).otherwise(kept)
    parts = F.transform(kept, lambda t: message(t["role"], t["content"], template, tokenizer))

    def whole(p: Column) -> Column:
        ids, loss = F.flatten(F.transform(p, lambda x: x["ids"])), F.flatten(F.transform(p, lambda x: x["loss"]))
        attention = F.transform(ids, lambda _: F.lit(1))
        if max_length is not None:
            cut = lambda c, fill: A.pad_right(A.truncate(c, max_length, side), max_length, fill)
            ids, loss, attention = cut(ids, pad), cut(loss, 0), cut(attention, 0)
        positions = F.zip_with(F.transform(attention, lambda _, i: i), attention, lambda i, a: i * a)
        return F.struct(ids.alias("ids"), loss.alias("loss"), attention.alias("attention"), positions.alias("positions"))

    return A.let(parts, whole)


def pair(prompt: Column, chosen: Column, rejected: Column, tokenizer: Tokenizer, max_length: int, end: int | None = None) -> Column:
    """Structs ids and attention of a prompt with its chosen and its rejected response, in this order, padded with 0 to one length."""
    tail = F.array(F.lit(end)) if end is not None else F.array().cast("array<int>")

    def one(response: Column) -> Column:
        ids = F.concat(tokenizer(prompt), tokenizer(response), tail)
        return A.let(ids, lambda x: F.struct(A.pad_right(A.truncate(x, max_length), max_length, 0).alias("ids"), A.pad_right(A.truncate(F.transform(x, lambda _: F.lit(1)), max_length), max_length, 0).alias("attention")))

    return F.array(one(chosen), one(rejected))


def stream(turns: Column, template: Template, tokenizer: Tokenizer) -> Column:
    """A rollout's continuous ids: struct prompt, response, loss and boundaries (where each turn of the response begins).

    The prompt ends with the header of the first assistant turn. After it, assistants' ids are the model's own (loss 1);
    other turns, and the headers that call for the next answer, are put in between (loss 0).
    """
    first = F.array_position(F.transform(turns, lambda t: t["role"]), F.lit("assistant")).cast("int")
    parts = F.transform(turns, lambda t: message(t["role"], t["content"], template, tokenizer))

    def cut(p: Column) -> Column:
        at = F.when(first > 0, first).otherwise(F.size(p) + 1)
        before = F.flatten(F.transform(F.slice(p, 1, at - 1), lambda x: x["ids"]))
        head = F.when(first > 0, F.slice(F.try_element_at(p, at)["ids"], 1, template.header_size)).otherwise(F.array().cast("array<int>"))
        rest = F.slice(p, at, F.greatest(F.size(p) - at + 1, F.lit(0)))
        own = lambda k: F.flatten(F.transform(rest, lambda x, i: F.when(i == 0, F.slice(x[k], template.header_size + 1, F.greatest(F.size(x[k]) - template.header_size, F.lit(0)))).otherwise(x[k])))
        sizes = F.transform(rest, lambda x, i: F.size(x["ids"]) - F.when(i == 0, template.header_size).otherwise(0))
        starts = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, n: a + n))
        return F.struct(F.concat(before, head).alias("prompt"), own("ids").alias("response"), own("loss").alias("loss"), starts.alias("boundaries"))

    return A.let(parts, cut)


#: Which role may follow which; the start of a conversation is "".
FOLLOWS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool", ""), "tool": ("tool", "assistant")}


def accumulated(rows: DataFrame, key: str, order: str, role: str, content: str, template: Template, tokenizer: Tokenizer, max_length: int) -> DataFrame:
    """One request per conversation, built turn by turn: ids, loss, attention, positions, turns, and state.

    state: "finished" if the last turn is an assistant's, "waiting" if it is not, "length" if ids had to be cut,
    "invalid" where a turn may not follow the one before.
    """
    turns = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.coalesce(F.col(content), F.lit("")).alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    df = rows.groupBy(key).agg(turns.alias("_t"))
    allowed = F.create_map(*[F.lit(x) for a, bs in FOLLOWS.items() for x in (a, ",".join(bs))])
    roles = F.transform("_t", lambda t: t["role"])
    ok = F.forall(F.zip_with(F.concat(F.array(F.lit("")), roles), roles, lambda a, b: b.isNull() | F.coalesce(F.array_contains(F.split(allowed[a], ","), b), F.lit(False))), lambda x: x)
    df = df.select(key, F.size("_t").alias("turns"), ok.alias("_ok"), F.try_element_at(roles, F.lit(-1)).alias("_last"), assembled(F.col("_t"), template, tokenizer).alias("x"))
    state = F.when(~F.col("_ok"), "invalid").when(F.size("x.ids") > max_length, "length").when(F.col("_last") == "assistant", "finished").otherwise("waiting")
    return df.select(key, "turns", state.alias("state"), *[F.slice(F.col(f"x.{c}"), 1, max_length).alias(c) for c in ("ids", "loss", "attention", "positions")])
