"""Chat formatting from event logs: fold the events of a conversation into messages, render them, read them back.

An event is (conversation, sequence, kind, message, role, text):

- ``message``: a finished message of its own, its ``message`` is ignored;
- ``open``, ``edit``, ``regenerate``: set the text of ``message`` to ``text`` (null: empty) from here on; ``regenerate`` also removes every message
  first seen after this one and before the event: they answered a text that is gone;
- ``delta``: adds ``text`` to ``message``;
- ``delete``: removes ``message`` unless a later event brings it back.

A streamed message takes the place of its first event and the role of its earliest event with one. Events of one sequence number apply in
the order open, edit and regenerate, delta, delete; an event of a streamed message delivered twice counts once. ``message`` rows
count each, however often they repeat; equal sequence numbers are ordered by role and text. Kinds other than these, and streamed
events without a message, are ignored. A null sequence comes first, a null role is the empty role, a null conversation is a conversation.

Template: every turn is an opening control string, a space, the escaped text, a space, a closing control string and a newline. Inside
texts every control string gets a backslash in front; no control string holds a backslash or a blank, none overlaps another, and real
ones never follow a backslash, so the escape is undone by taking that one backslash away. Roles without control strings
of their own are named inside the turn. ``runs`` is the loss mask: per turn, the characters before the text, of the text and after it, and whether it counts.

Scale: events of a streamed message are folded by (conversation, message) first, so a hot conversation spreads over its messages; finished
messages then meet by conversation, merged within each task before the one shuffle. A conversation is one value of the result, as the
digest over it demands, so it must fit in a row (2 GB). Only DataFrame functions are used; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, TEXT = ("[ROLE]", "[/ROLE]"), "[TEXT]"
CONTROL = r"</?s>|<</?SYS>>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]"
RANK = {"open": 0, "edit": 1, "regenerate": 1, "delta": 2, "delete": 3}
FIRST = -(1 << 63)


# ---- folding


def _streamed(events: DataFrame) -> DataFrame:
    """One row a streamed message: where it opens, its role and text, the last regeneration."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in RANK.items()])
    rows = events.where(F.col("kind").isin(*RANK) & F.col("msg").isNotNull()).select(
        "conv", "seq", "msg", "kind", "role", F.struct("seq", rank.alias("rank"), "text", "kind").alias("event"))
    found = rows.groupBy("conv", "msg").agg(
        F.min("seq").alias("seq"), F.min_by("role", F.struct("event")).alias("any_role"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("event", "role"))).alias("named"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.array_sort(F.collect_set("event")).alias("log"))
    starts = F.filter("log", lambda e: e["rank"] < 2)
    start = F.element_at(starts, -1)
    texts = F.filter("log", lambda e: (e["rank"] < 3) & (F.size(starts).eqNullSafe(0) | F.coalesce(
        (e["seq"] > start["seq"]) | ((e["seq"] == start["seq"]) & ((e["rank"] == 2) | (e == start))), F.lit(True))))
    last = F.element_at("log", -1)
    return found.where(last["kind"] != "delete").select(
        "conv", "seq", F.coalesce(F.col("named")["role"], F.lit("")).alias("role"), F.array_join(F.transform(texts, lambda e: e["text"]), "").alias("text"), "again")


def _cuts(log: Column) -> Column:
    """Spans of sequence numbers emptied by regenerations, merged where they overlap: (after, before), in order."""
    spans = F.array_sort(F.transform(F.filter(log, lambda m: m["again"] > m["seq"]), lambda m: F.struct(m["seq"].alias("after"), m["again"].alias("before"))))
    kind = "array<struct<after:bigint,before:bigint>>"

    def merge(out: Column, s: Column) -> Column:
        top = F.try_element_at(out, F.lit(-1))
        grown = F.struct(top["after"].alias("after"), F.greatest(top["before"], s["before"]).alias("before"))
        inside = F.coalesce(s["after"] < top["before"], F.lit(False))
        return F.when(inside, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(s))).cast(kind)

    return F.aggregate(spans, F.expr(f"cast(array() as {kind})"), merge)


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", msg: str = "msg", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv``, turns array<struct<role, text>>): the messages of every conversation that are left at its end, in order."""
    rows = events.select(
        F.col(conv).alias("conv"), F.coalesce(F.col(seq).cast("long"), F.lit(FIRST)).alias("seq"), F.col(kind).alias("kind"), F.col(msg).alias("msg"),
        F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = rows.where(F.col("kind") == "message").select("conv", "seq", F.coalesce("role", F.lit("")).alias("role"), "text", F.lit(None).cast("long").alias("again"))
    log = whole.unionByName(_streamed(rows)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text", "again"))).alias("log"))
    cut = log.withColumn("cuts", _cuts(F.col("log")))
    left = F.when(F.size("cuts") == 0, F.col("log")).otherwise(
        F.filter("log", lambda m: ~F.exists("cuts", lambda c: (m["seq"] > c["after"]) & (m["seq"] < c["before"]))))
    return cut.select(F.col("conv").alias(conv), F.transform(left, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("turns"))


# ---- rendering and reading back


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def _by_role(role: Column, which: int, other: Column) -> Column:
    out = other
    for name, marks in MARKS.items():
        out = F.when(role == name, F.lit(marks[which])).otherwise(out)
    return out


def _rendered(turn: Column) -> Column:
    """Head, escaped text and tail of a turn, and whether its text is trained on."""
    role = turn["role"]
    named = F.concat(F.lit(f"{OTHER[0]} "), escape(role), F.lit(f" {TEXT}"))
    return F.struct(
        F.concat(_by_role(role, 0, named), F.lit(" ")).alias("head"), escape(turn["text"]).alias("body"),
        F.concat(F.lit(" "), _by_role(role, 1, F.lit(OTHER[1])), F.lit("\n")).alias("tail"), (role == "assistant").alias("loss"))


def render(folded: DataFrame, turns: str = "turns") -> DataFrame:
    """``folded`` with ``formatted`` and ``runs`` array<struct<before, chars, after, loss>>, in place of ``turns``."""
    parts = folded.withColumn(turns, F.transform(turns, _rendered))
    return parts.select(
        *[F.col(f"`{c}`") for c in folded.columns if c not in (turns, "formatted", "runs")],
        F.array_join(F.transform(turns, lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.transform(turns, lambda p: F.struct(
            F.length(p["head"]).alias("before"), F.length(p["body"]).alias("chars"), F.length(p["tail"]).alias("after"), p["loss"].alias("loss"))).alias("runs"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    ends = "|".join(f" {m}" for m in (r"<</SYS>>", r"\[/INST\]", r"</s>", r"\[/ROLE\]"))
    pieces = F.filter(F.split(formatted, f"(?<={ends})\n", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        out = F.struct(
            unescape(F.regexp_extract(piece, r"(?s)^\[ROLE\] (.*?) \[TEXT\] ", 1)).alias("role"),
            unescape(F.regexp_extract(piece, r"(?s)^\[ROLE\] .*? \[TEXT\] (.*) \[/ROLE\]$", 1)).alias("text"))
        for name, (head, tail) in MARKS.items():
            inner = F.substr(piece, F.lit(len(head) + 2), F.length(piece) - F.lit(len(head) + len(tail) + 2))
            out = F.when(piece.startswith(head + " "), F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"))).otherwise(out)
        return out

    return F.transform(pieces, turn)


def digests(rendered: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the output says when read back: turns, trained text and lengths of every conversation."""
    read = rendered.select(conv, F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("read"))
    loss = F.array_join(F.transform(F.filter("read", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    told = read.select(conv, F.size("read").cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"), "formatted_chars")
    return told.select(
        conv, "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def finished(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log of finished messages."""
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("msg"), "role", "text")


def with_probe(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -1, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    probe = rows.sparkSession.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def oracle() -> str:
    """The contract over the same rows in DuckDB SQL; the template's lengths are those of ``MARKS``."""
    frame = "CASE role " + " ".join(f"WHEN '{n}' THEN {len(a) + len(b) + 3}" for n, (a, b) in MARKS.items())
    escaped = f"length(regexp_replace({{}}, '({CONTROL})', '\\\\\\1', 'g'))"
    return f"""
        WITH told AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
        sized AS (
            SELECT *, {escaped.format("text")} + {frame} ELSE {sum(map(len, OTHER)) + len(TEXT) + 5} + {escaped.format("role")} END AS chars FROM told)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id"""
