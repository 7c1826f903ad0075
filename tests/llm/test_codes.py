"""Vector codes, source divergence and BPE against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterlab.llm import bpe, divergence, vector_codes as VC

from .conftest import awkward_rows


def codes_by_force(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label) -> {row: (code, error, label_error)}, books."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(4096 * x) for x in r[1]] for r in kept]
    width = max(map(len, ints), default=0)
    width += -width % parts
    d = width // parts
    ints = [v + [0] * (width - len(v)) for v in ints]
    split = [[tuple(v[p * d : (p + 1) * d]) for p in range(parts)] for v in ints]
    books = [[v[p] for v in split[:entries]] for p in range(parts)]

    def near(p, q):
        return min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in split:
                members[near(p, v[p])[1]].append(v[p])
            for k, m in members.items():
                books[p][k] = tuple(sum(x) // len(m) for x in zip(*m, strict=True))
    found = [[near(p, v[p]) for p in range(parts)] for v in split]
    by_label = Counter()
    for r, f in zip(kept, found, strict=True):
        by_label[r[2]] += sum(x for x, _ in f)
    out = [(r[0], "".join(f"{k:02x}" for _, k in f), sum(x for x, _ in f), by_label[r[2]]) for r, f in zip(kept, found, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def codes(df):
    books = VC.train(df)
    rows = VC.with_total(VC.encode(df, books), "label", "error", "label_error")
    return [(r.vec_id, r.code, r.error, r.label_error) for r in rows.collect()], VC.digest(books)


def ordered(rows):
    return sorted(rows, key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, row string"


@pytest.mark.parametrize("seed", [1, 2])
def test_vector_codes_equal_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.3, (12, 24)).astype(np.float32)
    rows = [(int(i), (base[i % 12] + (0 if i % 3 else 1) * rng.normal(0, 0.1, 24)).astype(np.float32).tolist(), int(i % 4) if i % 7 else None) for i in rng.permutation(200)]
    rows += [(1000, None, 1), (1001, [0.5] * 23 + [None], 1), (1002, [float("nan")] + [0.1] * 23, 1), (1003, [float("inf")] * 24, 1), (1004, [float("-inf")] + [0.0] * 23, None)]
    rows += [(3, rows[0][1], 1), (3, rows[0][1], 1), (None, rows[1][1], None), (500, [0.0] * 24, 9), (501, [-0.0001] * 24, 9)]
    monkeypatch.setattr(VC, "FREQUENT", 5)
    monkeypatch.setattr(VC, "BLOCK", 64)
    df = spark.createDataFrame([(*r, "mine", "x") for r in rows], SCHEMA).repartition(4)
    got, book = codes(df)
    wanted, wanted_book = codes_by_force(rows)
    assert ordered(got) == ordered(wanted) and book == wanted_book


def test_vector_codes_of_few_and_unequal_vectors(spark):
    for rows in ([], [(1, None, 1)], [(5, [0.1] * 8, None)], [(1, [0.25] * 9, 1), (2, [1.5], 1), (3, [], 2), (4, [0.25] * 9, 1)], [(1, [], 1)]):
        got, book = codes(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))
        wanted, wanted_book = codes_by_force(rows)
        if rows and rows[0][1] == []:
            assert [r[2:] for r in got] == [(0, 0)]
        else:
            assert (ordered(got), book) == (ordered(wanted), wanted_book)


def test_orchard_search_measures_few_entries_and_keeps_ties_low():
    rng = np.random.default_rng(4)
    entries = rng.integers(-4000, 4000, (16, 3))
    entries[9] = entries[2]
    q = np.concatenate([entries, entries[:4] + 1, rng.integers(-5000, 5000, (500, 3)), (entries[:1] + entries[1:2]) // 2])
    best, d = VC.nearest(VC.neighbours(entries), q)
    all_d = ((q[:, None] - entries[None]) ** 2).sum(-1)
    assert (best == all_d.argmin(1)).all() and (d == all_d.min(1)).all()


def test_a_component_too_large_for_exact_sums_is_an_error(spark):
    df = spark.createDataFrame([(1, [20000.0] * 8, 1, "", "")], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        VC.train(df)


def audit_by_force(rows, min_docs=10, top=10):
    """rows: (text, lang, source) -> set of result tuples."""
    counts, total, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        counts[lang, source].update(found)
        total[lang].update(found)
        docs[lang].update(found.keys())
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        price = {}
        for name, c in [(None, total[lang]), *((s, counts[lang, s]) for s in sources)]:
            n = sum(c[t] for t in kept)
            price[name] = {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            pairs = [(sum(f(price[s][t], price[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(price[s][t], price[None][t]), t) for t in kept if counts[lang, s][t] and price[s][t] > price[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, rank))
    return out


def test_audit_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in ("st", "wa", "Éc", "日本", "lo") for b in ("one", "ter", "HO", "ß", "ng", "ra")]
    rows = []
    for i in range(400):
        lang = rnd.choice(["en", "en", "de", None, ""])
        source = rnd.choice(["a", "b", "B", "é", "z", None]) if lang else rnd.choice(["p", "q"])
        shift = len(source or "") + ord((source or "0")[0])
        rows.append((" ".join(words[int(abs(rnd.gauss(shift % 11, 6))) % len(words)] for _ in range(rnd.randrange(0, 40))) + rnd.choice(["", "! 1_2", "\x00x\x7f"]), lang, source))
    rows += [(None, "en", "mute"), ("", "xx", "a"), ("few words", "xx", "b"), ("only one", "yy", "a"), rows[0], rows[0], ("stone " * 30_000, "en", "long")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, value int, item string, rank int").repartition(5)
    wanted = audit_by_force(rows)
    got = [tuple(r) for r in divergence.audit(df).collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    for name, value in (("BLOCK_TERMS", 64), ("COLUMNS", 5), ("PIECE", 300), ("BROADCAST_ROWS", 0), ("BLOCK_COUNTS", 40)):
        monkeypatch.setattr(divergence, name, value)
    got = [tuple(r) for r in divergence.audit(df).collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_audit_of_nothing(spark, nothing):
    assert divergence.audit(nothing).count() == 0
    one = spark.createDataFrame([(1, None, None, None, 0)], nothing.schema)
    assert divergence.audit(one).count() == 0


def digests(df):
    done = bpe.encode_decode(df).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("a"), F.sha2(F.col("decoded").cast("binary"), 256).alias("b"))
    return sorted(map(tuple, done.collect()), key=str)


def digests_by_force(rows):
    tokenizer = Tokenizer.from_file(bpe.VOCABULARY)
    out = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=str)


def test_bpe_equals_the_tokenizer(spark, monkeypatch):
    rnd = random.Random(3)
    some = ["<|endoftext|>", "<|endof", " ", "  ", "\n", "\r\n", "\t", "\u3000", "\x85", "'s", "'LL", "'", "a", "Bee", "12", "½", "é", "e\u0301", "!", "?!", "日本", "\U0001f600", "\U00016fe0", "\x00"]
    rows = [(i, "".join(rnd.choice([*some, chr(rnd.randrange(1, 0xD800)), chr(rnd.randrange(0xE000, 0x110000))]) for _ in range(rnd.randrange(50)))) for i in range(2000)]
    rows += [(-1, None), (-2, ""), (-3, "x" * 60_000), (-4, " " * 5000 + "y"), (-5, "<|endoftext|>" * 3), (-6, "say 'tis<|endoftext|>  <|endoftext|> b"), (7, "again"), (7, "again"), (None, "no id")]
    assert digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == digests_by_force(rows)
    monkeypatch.setattr(bpe, "CHUNK", 500)
    rows = rows[:200] + [(-9, "one word " * 400)]
    assert digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)) == digests_by_force(rows)


def test_bpe_of_awkward_rows(spark, awkward, nothing):
    assert digests(awkward) == digests_by_force(awkward_rows())
    clash = awkward.withColumn("ids", F.lit(1)).withColumn("word", F.lit("w")).withColumn("chunk", F.lit(2))
    out = bpe.encode_decode(clash)
    assert out.columns == ["doc_id", "lang", "source", "id", "score", "row", "removed_lines", "word", "chunk", "n_tokens", "ids", "decoded"]
    assert {r.word for r in out.collect()} == {"w"}
    assert bpe.encode_decode(nothing).count() == 0


def test_word_classes_agree_with_the_tokenizer_at_their_borders(spark):
    """Every character at which a class begins or ends, in a context that shows its class."""
    import itertools

    split = Tokenizer.from_file(bpe.VOCABULARY).pre_tokenizer.pre_tokenize_str
    edges = sorted({int(x, 16) + d for x in re.findall(r"\\x\{([0-9a-f]+)\}", bpe.word_pattern()) for d in (-1, 0, 1)})
    rows = [(f"a{chr(c)}1{chr(c)}!{chr(c)} ",) for c in edges if 0 < c < 0x110000 and not 0xD800 <= c < 0xE000]
    got = [list(itertools.accumulate(map(len, r.w))) for r in spark.createDataFrame(rows, "t string").select(bpe.split_words(F.col("t")).alias("w")).collect()]
    assert got == [[b for _, (_, b) in split(t)] for (t,) in rows]


def test_decode_skips_unknown_ids(spark):
    rows = [(1, [15496, 995, 50256]), (2, []), (3, None), (4, [99999, 0])]
    got = {r.k: bytes(r.bytes) for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), "k").collect()}
    assert got == {1: b"Hello world<|endoftext|>", 2: b"", 3: b"", 4: b"!"}


def test_bpe_gives_a_chunk_back_in_bounded_batches():
    """Ids and texts of a chunk go back in several batches, in the order of its texts."""
    texts = ["word " * (i % 7) + "é\U0001f600" * (i % 3) for i in range(400)]
    words = [bpe._tokenizer(bpe.VOCABULARY).pre_tokenizer.pre_tokenize_str(t) for t in texts]
    words = [[t[a:b] for _, (a, b) in w] for t, w in zip(texts, words, strict=True)]
    names = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    ids = bpe.encode_words(list(names))
    pack = lambda x: bpe._packed(np.array(x, np.uint32))
    table = pa.table({"steps": [pack(np.diff(np.arange(len(names)), prepend=0))], "sizes": [pack([len(x) for x in ids])], "ids": [pack([i for x in ids for i in x])]})
    rows = pa.table({"rows": [list(range(400))], "counts": pa.array([[len(w) for w in words]], pa.list_(pa.int32())), "numbers": [pack([names[w] for ws in words for w in ws])]})
    whole = bpe._placed(bpe.VOCABULARY)(rows, table)
    bpe.OUT_BYTES, before = 1000, bpe.OUT_BYTES
    try:
        parts = bpe._placed(bpe.VOCABULARY)(rows, table)
    finally:
        bpe.OUT_BYTES = before
    assert len(parts.to_batches()) > 3 and parts.combine_chunks().equals(whole.combine_chunks())
    assert parts["decoded"].to_pylist() == texts and parts["row"].to_pylist() == list(range(400))
