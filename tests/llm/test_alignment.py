"""Token alignment against a walk over both token sequences."""

import collections
import hashlib
import os
import random

import pytest

from fieldlens.llm import alignment

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{alignment.FOLDER}/{alignment.A_FILE}"), reason="no tokenizer files")
SCHEMA = "doc_id long, text string, n_a string, chunk string, ids string"


def tokens():
    """Encoders and token bytes, from the tokenizers' own libraries."""
    a = tokenizers.Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")
    letters = alignment._bytes_of_letters()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if not t.startswith("<|")}
    b_bytes = {i: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]}
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), b.encode, a_bytes, b_bytes


def walk(rows):
    encode_a, encode_b, a_bytes, b_bytes = tokens()
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            a, b = [], []
        links, groups, i, j, at_a, at_b, left, right = [], [], 0, 0, 0, 0, [], []
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = at_a + len(a_bytes[a[i]]), at_b + len(b_bytes[b[j]])
            if end_a <= end_b:
                left.append(str(a[i]))
            if end_b <= end_a:
                right.append(str(b[j]))
            if end_a == end_b:
                groups.append(f"{','.join(left)}|{','.join(right)}")
                left, right = [], []
            if end_a <= end_b:
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                j, at_b = j + 1, end_b
        counts.update(set(links))
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = collections.Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return [(d, a, b, g, len(ls), sum(counts[p] == top[p[0]] for p in ls), sum(counts[p] for p in ls), h) for d, a, b, g, ls, h in docs], counts


HARD = ["", None, "a▁b", "<s>x</s><|endoftext|><unk> [INST]", "tab\t\n x  y z \x1c \x85 q\r\n end  ", "日本語 текст 🙂🙂 naïve é", "x" * 5000, "  lead", "\nlead", " ", "\n",
        "a\x00b", "aaa aaaa aaaaa " * 30, "don't can't I'll 's 'd", "  x　y  z", "one\n\n\ntwo \n three", "0123456789 " * 40, "é ﬁ ﾊ"]


def test_against_a_walk(spark, sf_dir):
    rng = random.Random(5)
    letters = [" ", "\n", "\t", "a", "b", "the", "é", "日", "🙂", ".", ",", "'s", "▁", "  ", "1", "x\x1c", "Z", "-"]
    rows = [(k, t) for k, t in enumerate(HARD)] + [(100 + k, "".join(rng.choices(letters, k=rng.randrange(60)))) for k in range(200)]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + [(None, "a null id"), rows[5], rows[5]]
    df = spark.createDataFrame([(i, t, "n", "c", "i") for i, t in rows], SCHEMA).repartition(5)
    want, counts = walk(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([tuple(r) for r in alignment.align(df).collect()], key=key) == sorted(want, key=key)
    top = collections.Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    assert {tuple(r) for r in alignment.pair_counts(df).collect()} == {(a, b, n, n == top[a]) for (a, b), n in counts.items()}


def test_small_tables_of_words_and_chunks(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = sorted(map(tuple, alignment.align(df).collect()))
    for name, value in (("CHUNK", 3000), ("STEP", 700), ("KNOWN", 40)):
        monkeypatch.setattr(alignment, name, value)
    assert sorted(map(tuple, alignment.align(df).collect())) == whole


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None, "", "", "")], SCHEMA)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
