"""Chat logs against a plain replay, and the template against its own reading."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldlens.llm import chat

EVENT = "conv_id long, seq long, kind string, msg string, role string, text string, turn string, log string, cuts string"


def replay(rows):
    """The messages left at the end of each conversation, one event after the other."""
    out = {}
    convs = {}
    for c, seq, kind, msg, role, text in rows:
        convs.setdefault(c, []).append((seq if seq is not None else chat.FIRST, chat.RANK.get(kind, 0), kind, msg, role, text or ""))
    for c, events in convs.items():
        messages, order = {}, []
        for n, (seq, _, kind, msg, role, text) in enumerate(sorted(set(e for e in events if e[2] != "message"), key=lambda e: (e[0], e[1], e[5]))):
            if kind not in chat.RANK or msg is None:
                continue
            m = messages.setdefault(msg, {"seq": seq, "role": None, "text": "", "again": None, "gone": False})
            if m["role"] is None:
                m["role"] = role
            m["gone"] = kind == "delete"
            if kind in ("open", "edit", "regenerate"):
                m["text"] = text
            elif kind == "delta":
                m["text"] += text
            if kind == "regenerate":
                m["again"] = seq
        order = [(m["seq"], m["role"] or "", m["text"], m["again"]) for m in messages.values() if not m["gone"]]
        order += [(seq, role or "", text, None) for seq, _, kind, _, role, text in events if kind == "message"]
        cuts = [(s, a) for s, _, _, a in order if a is not None]
        known = any(kind == "message" for _, _, kind, *_ in events) or any(not m["gone"] for m in messages.values())
        if known:
            out[c] = [(r, t) for s, r, t, _ in sorted(order, key=lambda m: m[:3]) if not any(x < s < y for x, y in cuts)]
    return out


def folded(spark, rows):
    events = spark.createDataFrame([(*r, "t", "l", "c") for r in rows], EVENT)
    return chat.fold(events)


def test_fold_by_hand(spark):
    rows = [
        (1, 0, "message", None, "user", "hi"), (1, 1, "open", "a", "assistant", None), (1, 2, "delta", "a", None, "Hel"), (1, 3, "delta", "a", None, "lo"),
        (1, 3, "delta", "a", None, "lo"), (1, 4, "message", None, "user", "more"), (1, 5, "regenerate", "a", None, ""), (1, 6, "delta", "a", None, "Bye"),
        (1, 7, "message", None, "user", "ok"), (1, 8, "edit", "a", None, "Bye!"), (1, 9, "unknown", "a", None, "?"), (1, 10, "delta", None, None, "lost"),
        (2, 5, "delta", "b", "tool", "x"), (2, 6, "delete", "b", None, None), (2, 1, "message", None, None, None), (None, None, "message", None, "user", "n"),
        (3, 1, "message", None, "user", "same"), (3, 1, "message", None, "user", "same"), (3, 1, "message", None, "assistant", "tie")]
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in folded(spark, rows).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "Bye!"), ("user", "ok")], 2: [("", "")], None: [("user", "n")],
                   3: [("assistant", "tie"), ("user", "same"), ("user", "same")]}
    assert got == replay(rows)


@pytest.mark.parametrize("seed", range(4))
def test_fold_of_random_logs(spark, seed):
    rng = random.Random(seed)
    kinds = ["delta"] * 5 + ["open", "edit", "regenerate", "regenerate", "delete", "message", "message", "odd", None]
    rows = []
    for c in range(40):
        seqs = rng.sample(range(200), rng.randrange(1, 40))
        rows += [(c, s, rng.choice(kinds), rng.choice(["a", "b", "c", None]), rng.choice(["user", "assistant", None]), rng.choice(["x", "y ", "", None])) for s in seqs]
    rows += rng.sample([r for r in rows if r[2] != "message"], 20)  # delivered twice
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in folded(spark, rows).collect()} == replay(rows)


def test_stream_of_a_whole_table(spark, sf_dir):
    """Every row as a draft, its regeneration in pieces and an edit gives the same as the finished rows."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plain = chat.fold(chat.finished(rows))
    seq, text = F.col("turn") * 100, F.coalesce("text", F.lit(""))
    event = lambda at, kind, said: F.struct((seq + at).alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))
    log = F.array(event(0, "open", F.lit("draft")), event(1, "regenerate", F.lit("")), event(2, "delta", F.substring(text, 1, 40)),
                  event(3, "delta", F.substr(text, F.lit(41))))
    streamed = rows.select("conv_id", F.col("turn").cast("string").alias("msg"), "role", F.explode(log).alias("e")).select("conv_id", "msg", "role", "e.*")
    key = lambda df: sorted((r["conv_id"], [tuple(t) for t in r["turns"]]) for r in df.collect())
    assert key(chat.fold(streamed)) == key(plain)


CONTROLS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]", "\\", "\n", " ", "a", "é", "🙂", "<", ">", "[", "]", "s", "$1", "</s>\n"]


def test_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for c in range(300):
        for t in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "[TEXT] ", "</s>\n", "user "])
            rows.append((c, t, role, rng.choice([None, "", "x" * 3000, *["".join(rng.choices(CONTROLS, k=rng.randrange(12))) for _ in range(9)]])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.fold(chat.finished(df))).cache()
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["t"]] for r in rendered.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()} == want
    for r in rendered.collect():
        at, taken = 0, []
        for run in r["runs"]:
            at += run["before"]
            if run["loss"]:
                taken.append(r["formatted"][at:at + run["chars"]])
            at += run["chars"] + run["after"]
        assert at == len(r["formatted"])
        undone = [r0[0] for r0 in spark.createDataFrame([(t,) for t in taken], "t string").select(chat.unescape(F.col("t"))).collect()] if r["conv_id"] < 5 and taken else None
        assert undone in (None, [t for role, t in want[r["conv_id"]] if role == "assistant"])
    for r in chat.digests(rendered).collect():
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_native_and_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = chat.digests(chat.render(chat.fold(chat.finished(empty))))
    assert found.count() == 0
    plan = found._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    probe = chat.digests(chat.render(chat.fold(chat.finished(chat.with_probe(empty))))).collect()[0]
    assert (probe["conv_id"], probe["n_turns"], probe["loss_chars"]) == (-1, 2, 21)


def test_one_long_conversation(spark):
    df = spark.range(20000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some [INST] text " * 5).alias("text"))
    r = chat.digests(chat.render(chat.fold(chat.finished(df)))).collect()[0]
    assert (r["n_turns"], r["loss_chars"]) == (20000, 10000 * 85)
