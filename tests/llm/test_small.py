"""Every operator on small tables with nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, decontamination, language_id, near_copies, pii, quality_classifier, quality_rules, sharding, simhash, token_counts
from lodestone.llm.common import fold_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} tion{i}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))
TEXTS = [
    None, "", " \t\n ", "One.", "one.", "two words", BASE, BASE, BASE.upper(), BASE.replace("alpha5 ", "gamma "), BASE + " end", LONG, "café ÉTÉ ½ 日本 😀", "a b\x1cc", "x" * 5000,
    "the same line\nthe same line\n\nthe same line\n" * 4, "mail a.b@c.example.org, 10.0.0.1 and 1.2.3.4.5.6.7.8; 4716 2385 0961 3942 or +1 (743) 555-3824.", "<|endoftext|> 's don't  two  blanks\n\n x", "##** $$ || && " * 20,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s0", "s1", None][i % 3 - 1], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(3, "One.", "en", "s0", 4), (None, BASE, None, None, 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = {"score": F.lit("x"), "fp": F.lit(1), "key": F.lit("k"), "m": F.lit(2), "size": F.lit(3), "shard": F.lit(4), "component_id": F.lit(5), "row": F.lit(6), "verdict": F.lit(7), "ids": F.lit(8)}
    return df.withColumns(extra)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def words(t):
    return WORD.findall(t or "")


def test_bpe_equals_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert rows(bpe.digests(docs)) == sorted(want, key=str)
    assert bpe.digests(empty).count() == 0
    coded = bpe.encode_documents(docs)
    assert sorted(str(r.text) for r in bpe.decode_documents(coded).collect()) == sorted(r.text or "" for r in docs.collect())
    out = bpe.tokenized(docs)
    assert out.columns == [c for c in docs.columns if c not in ("text", "ids")] + ["n_tokens", "ids", "decodes"]
    assert out.filter("not decodes").count() == 0 and out.count() == docs.count()


def test_bpe_on_random_texts():
    import random

    from tokenizers import Tokenizer

    library, vocab, rnd = Tokenizer.from_file(bpe.default_path()), bpe.Vocabulary(open(bpe.default_path(), encoding="utf-8").read()), random.Random(4)
    parts = ["a", "th", "ing", " ", "  ", "\n", "é", "'s", "'", "1", "23", "!?", "😀", "ß", "\t", " ", "ly", "LL", "_", "\x85", "<|endoftext|>"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 1500), rnd.randint(0x4E00, 0x5000)])) for _ in range(25)) for _ in range(500)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = vocab.encode(t)
        assert ids.tolist() == e.ids, t
        assert vocab.decode(ids) == t


@pytest.mark.parametrize("unit", ["ab", "a1", "qzx", "\u4e00\u9fa5", "!?", " "])
def test_bpe_long_pieces(unit):
    """One piece of many characters equals the library, and takes time in proportion."""
    import time

    from tokenizers import Tokenizer

    vocab = bpe.Vocabulary(open(bpe.default_path(), encoding="utf-8").read())
    text = unit * 5000
    assert vocab.encode(text).tolist() == Tokenizer.from_file(bpe.default_path()).encode(text, add_special_tokens=False).ids
    start = time.process_time()
    vocab.encode(unit * (600_000 // len(unit.encode())))
    assert time.process_time() - start < 6


def test_bpe_memory_is_bounded_by_bytes():
    import random
    import string

    vocab, rnd = bpe.Vocabulary(open(bpe.default_path(), encoding="utf-8").read()), random.Random(1)
    for size in (2000, 30):
        vocab.encode(" ".join("".join(rnd.choices(string.ascii_letters, k=size)) for _ in range(40_000 if size < 100 else 500)))
        assert all(len(w) <= bpe.LONGEST for w in vocab.words)
    held = vocab.words.held
    assert 0 < held == sum(100 + bpe.getsizeof(k) + bpe.getsizeof(v) for k, v in vocab.words.items()) <= bpe.CACHE
    vocab.words.held = bpe.CACHE
    assert vocab.encode("another word") is not None and len(vocab.words) < 5 and len(vocab.words.old) > 1000


def brute_components(fps, radius):
    ids = [i for i, _ in fps]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    group = collections.defaultdict(list)
    for i in range(len(ids)):
        group[find(i)].append(ids[i])
    return [(ids[i], fps[i][1], min((x for x in group[find(i)] if x is not None), default=None)) for i in range(len(ids))]


def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs, empty):
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()], 3)
    for hot in (simhash.HOT, 1):
        got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, hot=hot).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [2048, 8])
def test_simhash_links_in_dense_balls(spark, limit):
    """A ball of many fingerprints around one centre, small buckets: every link within the radius is kept."""
    import random

    rnd = random.Random(7)
    fps = {0x1234_5678_9ABC_DEF0}
    while len(fps) < 150:
        x = rnd.choice(sorted(fps)[:5])
        for _ in range(rnd.randint(1, 4)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(30)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(3)
    from lodestone.llm.components import components

    root = {r.node: r.root for r in components(simhash.links(nodes, limit=limit)).collect()}
    got = collections.defaultdict(set)
    for x in signed:
        got[root.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, _, name in brute_components([(x, x & (1 << 64) - 1) for x in signed], 3):
        want[name].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_covering_masks_cover():
    import itertools

    masks = simhash.covering_masks()
    assert len(masks) == 15
    for at in itertools.combinations(range(64), 3):
        bits = sum(1 << i for i in at)
        assert any(not m & bits for m in masks), at


def test_near_copies_keep_one_of_each_group(spark, docs, empty):
    kept = near_copies.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # null and blank texts are one group, "One." in either case another, the copies of BASE a third (with the row without an id)
    assert ids == sorted([0, 3, 5, 6, *range(11, len(TEXTS))], key=str)
    assert near_copies.deduplicate(empty).count() == 0


def test_near_copies_in_a_large_group(spark):
    """Buckets over the limit are dealt into chunks and still give one group; other texts stay."""
    import random

    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = rnd.choices(vocabulary, k=400)
    data = []
    for i in range(300):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(400)] = f"edit{i}"
        data.append((i, " ".join(copy)))
    data += [(1000 + i, " ".join(rnd.choices(vocabulary, k=100))) for i in range(50)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    for limit in (2048, 100):
        assert sorted(r.doc_id for r in near_copies.deduplicate(df, limit=limit).collect()) == [0, *range(1000, 1050)]


def edited_pairs(similarities, words=200, seed=5):
    """doc_id, text: for each wanted similarity a text, and a copy with words changed far apart that is near that similarity."""
    import random

    rnd, data = random.Random(seed), []
    for k, s in enumerate(similarities):
        base = [f"p{k}w{i}x{rnd.randrange(10**6)}" for i in range(words)]
        changed = round((words - 4) * (1 - s) / (1 + s))  # shingles that one text has alone
        copy = list(base)
        copy[:changed] = [f"e{k}w{i}" for i in range(changed)]
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    return data


def exact_copies(data):
    """The doc_ids that stay, by exact similarity of all pairs."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in data if (w := t.lower().split()) is not None}
    having = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            having[g].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for e, n in collections.Counter(e for g in s for e in having[g] if e < d).items():
            if n / (len(s) + len(sets[e]) - n) >= 0.8:
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted(d for d in root if root[d] == d)


def test_near_copies_are_decided_exactly(spark):
    """Pairs close to the similarity on either side: an estimate gets some of them wrong."""
    data = edited_pairs([0.7 + 0.2 * i / 160 for i in range(161)])
    want = exact_copies(data)
    assert 161 < len(want) < 322
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_copies.deduplicate(df).collect()) == want


def test_near_copies_in_a_hot_template(spark):
    """Texts 0.75 alike share one bucket above the limit; the pairs at 0.81 in it are all found."""
    template = [f"t{i}" for i in range(200)]
    data = []
    for k in range(150):
        one = list(template)
        one[:24] = [f"own{k}w{i}" for i in range(24)]
        two = list(one)
        two[184:] = [f"more{k}w{i}" for i in range(16)]
        data += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    data += [(1000 + i, " ".join([*template[:199], f"z{i}"])) for i in range(150)]  # the largest part
    want = exact_copies(data)
    assert want == [*range(0, 300, 2), 1000]
    sets = [(d, 0, len(data), bytearray(near_copies.shingle_set(t).tobytes())) for d, t in data]
    sets = near_copies.cut(spark.createDataFrame(sets, "node bigint, `group` bigint, n bigint, shingles binary"), "test-sets")
    rows_ = spark.createDataFrame([(d, [1]) for d, _ in data], "node bigint, keys array<bigint>")
    linked = {r.node: r.root for r in near_copies.components(near_copies.links(rows_, sets, limit=100)).collect()}
    assert sorted(d for d, _ in data if linked.get(d, d) == d) == want


def test_near_copies_of_a_template_stay(spark):
    """Texts of one template, 0.72 alike on average, are no near copies but for a few pairs."""
    import random

    rnd = random.Random(8)
    template = [f"t{i}" for i in range(400)]
    data = []
    for k in range(300):
        text = list(template)
        for i in rnd.sample(range(400), 7):
            text[i] = f"x{k}w{i}"
        data.append((k, " ".join(text)))
    want = exact_copies(data)
    assert 290 < len(want) <= 300
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    for limit in (2048, 100):
        assert sorted(r.doc_id for r in near_copies.deduplicate(df, limit=limit).collect()) == want


def test_sharding_laws(spark, docs, empty):
    for df, n in ((docs, 5), (docs, 40), (docs.filter("text is not null and length(text) < 300"), 3)):
        got = sharding.shard_documents(df, n).collect()
        want = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect()]
        assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(want, key=str)
        for s in range(n):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
        assert all(0 <= r.shard < n for r in got)
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_is_even_and_keeps_groups(spark):
    rows_ = [(i, f"text {i} " + "x" * (i % 50)) for i in range(4000)] + [(10_000 + i, "a hot text of one group") for i in range(2000)] + [(20_000 + i, f"pair {i // 2}" * 20) for i in range(400)]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string").repartition(7)
    got = sharding.shard_documents(df, 40, piece_rows=20).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 0.12 * sizes.mean()
    shard = dict(zip(got.doc_id, got.shard))
    together = sum(shard[20_000 + 2 * i] == shard[20_001 + 2 * i] for i in range(200))
    assert together == 200
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_chat_collapse(spark):
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),  # a prefix of 2
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"),  # equal to 2
        (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
        (5, 5, "user", None), (5, 5, "user", None), (5, 7, None, ""),  # a repeated row, nulls
        (6, None, "user", "hi"),  # one turn: a prefix of 2
        (7, 0, "user", ""),  # not a prefix of 5: empty is not null
        (None, 0, "user", "hi"), (8, 3000, "user", "far"), (8, 2, "user", "near"),
    ]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("k", F.lit("clash")).withColumn("segment", F.lit(1))
    for chunk in (1024, 1):
        kept = {r.conv_id for r in chat.maximal(df, chunk).collect()}
        assert kept == {2, 4, 5, 7, 8}
    out = {(r.conv_id, r.segment): (r.n_turns, r.rendered) for r in chat.format_conversations(df).collect()}
    assert out[2, 0] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n")
    assert out[5, 0] == (2, "<|im_start|>user\n<|im_end|>\n<|im_start|>\n<|im_end|>\n")
    assert out[8, 0][0] == 2 and out[None, 0][0] == 1
    assert chat.format_conversations(df.filter("false")).count() == 0


def test_chat_many_null_and_equal_turns(spark):
    """Rows without a conversation or with one turn number are rendered in segments too, in order, and each counts once."""
    rows_ = spark.range(7000).select(F.when(F.col("id") < 3000, None).when(F.col("id") < 6000, 1).otherwise(2).alias("conv_id"), F.when(F.col("id") % 3 == 0, None).otherwise(5).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = chat.format_conversations(rows_.unionByName(rows_).repartition(9)).collect()
    assert max(r.n_turns for r in got) == 1024
    for conv, low, high in ((None, 0, 3000), (1, 3000, 6000), (2, 6000, 7000)):
        ids = range(low, high)
        want = sorted(f"t{i}" for i in ids if i % 3 == 0) + sorted(f"t{i}" for i in ids if i % 3)
        parts = sorted((r.segment, r.rendered) for r in got if r.conv_id == conv)
        assert [s for s, _ in parts] == list(range(-(-len(want) // 1024)))
        assert "".join(x for _, x in parts) == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in want)


def test_token_counts(spark, docs, empty):
    vocab = bpe.Vocabulary(open(bpe.default_path(), encoding="utf-8").read())
    want = sorted(((r.doc_id, len(vocab.encode_ordinary(r.text))) for r in docs.collect()), key=str)
    for block, run in ((1 << 16, 1024), (7, 3), (1, 2)):
        blocks, names = token_counts.write_flat(docs.filter("doc_id is null or doc_id <> 11").repartition(3), block=block)
        found = token_counts.documents_in(blocks, run=run).join(names, ["file", "doc"])
        assert sorted(((r.doc_id, r.n_tokens) for r in found.collect()), key=str) == [w for w in want if w[0] != 11]
    blocks, names = token_counts.write_flat(docs)
    found = token_counts.documents_in(blocks).join(names, ["file", "doc"])
    assert sorted(((r.doc_id, r.n_tokens) for r in found.collect()), key=str) == want
    blocks, names = token_counts.write_flat(empty)
    assert token_counts.documents_in(blocks).count() == 0


def test_token_width_follows_the_vocabulary(spark, tmp_path):
    """A vocabulary beyond 16 bits gets wide ids; one without the separator is an error."""
    import json

    import public_tokenizers

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    assert token_counts.layout() == (50256, "<u2")
    spec["added_tokens"] = [dict(spec["added_tokens"][0], id=70_000)]
    spec["model"]["vocab"] = {k: v for k, v in spec["model"]["vocab"].items() if k != "<|endoftext|>"}
    wide = str(tmp_path / "wide.json")
    json.dump(spec, open(wide, "w", encoding="utf-8"))
    assert token_counts.layout(wide) == (70_000, "<u4")
    blocks, names = token_counts.write_flat(spark.createDataFrame([(1, "two words"), (2, ""), (3, "more of them")], "doc_id bigint, text string"), wide, block=2)
    found = token_counts.documents_in(blocks, 70_000, width="<u4").join(names, ["file", "doc"])
    assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == [(1, 2), (2, 0), (3, 3)]
    with pytest.raises(ValueError):
        token_counts.layout(end="<none>")


def test_token_scan_of_a_file_that_was_cut_off(spark):
    import numpy as np

    ids = np.array([1, 2, 9, 9, 3, 9, 4, 5, 6], "<u2")
    for size in (1, 2, 4, 20):
        data = [(0, i, ids[a : a + size].tobytes()) for i, a in enumerate(range(0, len(ids), size))]
        df = spark.createDataFrame(data, "file int, block bigint, ids binary")
        got = sorted((r.doc, r.n_tokens, r.closed) for r in token_counts.documents_in(df, 9, run=2).collect())
        assert got == [(0, 2, True), (1, 0, True), (2, 1, True), (3, 3, False)]


def test_quality_rules_base(spark, docs, empty):
    want = []
    for r in docs.collect():
        t = r.text or ""
        w = words(t)
        at = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if at[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = quality_rules.quality_rules(docs)
    fields = quality_rules.FIELDS[:5]
    assert rows(got.select("doc_id", *(f"m.{f}" for f in fields), "verdict.base_failed")) == sorted(want, key=str)
    assert got.filter("verdict.kept and verdict.base_failed").count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 0
    assert kept.count() == got.filter("verdict.kept").count()


def test_quality_fences_follow_their_group(spark):
    """A source where symbols are usual gets a higher fence; a few rows lean on their language."""
    plain = " ".join(f"word{i}" for i in range(60))
    code = " ".join(f"x{i} #{'$' * (i % 3)}" for i in range(60))
    data = [(i, plain, "en", "prose") for i in range(150)] + [(1000 + i, code, "en", "code") for i in range(150)] + [(2000, code, "en", "prose"), (3000, code, "fr", "tiny"), (3001, plain, "fr", "tiny")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.quality_rules(df).filter("verdict.kept").collect()}
    assert {0, 1000, 3001} <= kept and 2000 not in kept


def test_pii_base_spans(spark, docs, empty):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0

    want = []
    for r in docs.collect():
        t, s = r.text or "", []
        s += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        s += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        s += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(re.sub(r"[^0-9]", "", m[0]))]
        s += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
        s.sort()
        text = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in s)
        want.append((r.doc_id, *(sum(k == i for _, k, _ in s) for i in range(4)), hashlib.sha256(text.encode()).hexdigest(), text))
    got = pii.personal_data(docs).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted((w[:-1] for w in want), key=str)
    for r in got:
        base = next(w[-1] for w in want if w[:-1] == tuple(r)[:-1])
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert pii.personal_data(empty).count() == 0
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.filter("text is null").count() == docs.filter("text is null").count()
    hit = next(r for r in clean.collect() if r.doc_id == 16)
    assert "@" not in hit.text and "555" not in hit.text and hit.n_chars == len(hit.text)


def test_pii_scans_equal_the_patterns():
    import random

    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    checks = (lambda s: True, pii._is_ip, pii._is_card, pii._is_phone)
    rnd = random.Random(1)
    for _ in range(20_000):
        t = "".join(rnd.choices(rnd.choice(["a.@-", "a1.@ -+", "1. ", "12 -+().", "a@b.cé \n.1-_%+", "4716 2385-0", "0.25 1+"]), k=rnd.randint(1, 40)))
        assert pii.base_spans(t) == sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t) if checks[k](m[0])), t


@pytest.mark.parametrize("unit", ["1", "a", "a@", "1.", "1-", "+1(", "a.", "@b."])
def test_pii_long_runs_take_linear_time(unit):
    import time

    text = unit * (2_000_000 // len(unit)) + "@"
    start = time.process_time()
    pii.find([text, "call (743) 555-3824"], pii.train())
    assert time.process_time() - start < 10


def test_pii_windows_of_very_different_length():
    """A long window among short ones is decoded alone, with the labels that it gets by itself."""
    import numpy as np

    field = pii.train()
    rng = np.random.default_rng(2)
    windows = [rng.integers(0, len(field.names), (n, 5)) for n in (3, 70_000, 1, 5, 40_000, 3)]
    for w, together in zip(windows, field.best(windows)):
        assert together.tolist() == field.best([w])[0].tolist()


def test_pii_field():
    field = pii.train()
    assert pii.letters_stay_outside(field)
    wrong = 0
    for text, labels in pii.labelled_table(400, seed=99):  # not the training seed
        found = pii.find([text], field)[0][1]
        wrong += bool(found) != any(y != "-" for y in labels)
    assert wrong <= 4
    # windows give the labels that whole texts give
    for text, _ in pii.labelled_table(60, seed=5):
        text = " ".join(["plain words here"] * 5 + [text] + ["more words"] * 9 + [text])
        tokens = [(m.start(), m.end()) for m in pii.RUN.finditer(text)]
        whole = field.best([field.ids([pii.shape(text[a:b]) for a, b in tokens])])[0]
        marked = {tokens[i] for i in range(len(tokens)) if whole[i]}
        parts = list(pii.windows(text))
        labels = field.best([field.ids([pii.shape(text[a:b]) for a, b in w]) for w in parts])
        assert marked == {t for w, ys in zip(parts, labels) for t, y in zip(w, ys) if y}
    base, every = pii.find(["call (743) 555-3824 or write jo [at] mail [dot] com, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" v 2.0"], field)[0]
    assert not base and [k for _, k, _ in every] == [3, 0]


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    field = pii.Field({f"f{i}": i for i in range(8)}, np.vstack([rng.normal(size=(8, 5)), np.zeros((1, 5))]), rng.normal(size=(5, 5)))
    windows = [rng.integers(0, 9, (n, 5)) for n in (1, 2, 4, 3)]
    for w, got in zip(windows, field.best(windows)):
        score = lambda path: sum(field.emit[w[i], y].sum() for i, y in enumerate(path)) + field.step[0, path[0]] + field.step[path[-1], 0] + sum(field.step[a, b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
        assert tuple(got) == max(itertools.product(range(5), repeat=len(w)), key=score)


def test_decontamination(spark, docs, empty):
    item = " ".join(f"item{i}" for i in range(40))
    near = item.replace("item20", "changed")
    half = " ".join(item.split()[:20])
    data = [(1, f"before, {item} after"), (2, f"x {near.upper()}! y"), (3, half + " and then other words"), (4, None), (5, ""), (6, "short one"), (7, item), (7, item), (8, "a\n" + item.replace(" ", "***\n") + " b"), (9, "no short here")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("similarity", F.lit(0))
    benchmark = spark.createDataFrame([(10, item), (11, item), (12, "short one"), (13, None), (14, "")], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.matches(df, benchmark).collect())
    assert got == sorted([(d, i) for d in (1, 2, 7, 7, 8) for i in (10, 11)] + [(6, 12)])
    kept = decontamination.decontaminate(df, benchmark)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 9]
    assert decontamination.matches(empty, benchmark).count() == 0
    assert decontamination.matches(df, benchmark.filter("false")).count() == 0
    many = [b for b in decontamination.item_blocks(benchmark, max_bytes=0)]
    assert len(many) == 4 and sum(bool(b.matches(item)) for b in many) == 2
    named = benchmark.select(F.lit(None).cast("decimal(5,2)").alias("item_id"), "text")  # ids of any type, nulls too
    assert decontamination.matches(df, named).filter("item_id is null").count() == len(got)


def test_decontamination_behind_another_preamble(spark):
    """Items with a shared template: a document with an item's own part after other words is similar by weight, far by SimHash."""
    template = [f"t{i}" for i in range(100)]
    items = [(i, " ".join([*template, *(f"own{i}w{j}" for j in range(40))])) for i in range(300)]
    data = [(i, " ".join([*(f"other{i}w{j}" for j in range(100)), *(f"own{i}w{j}" for j in range(40))])) for i in range(300)]
    data.append((1000, " ".join([*template, *(f"other{j}" for j in range(40))])))
    df, benchmark = spark.createDataFrame(data, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.matches(df, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(300)]
    assert all(r.first_word == 0 and r.similarity == pytest.approx((36 + 0) / (36 + 4 + 96 / 300), abs=1e-9) for r in got)


def test_decontamination_weights_do_not_depend_on_blocks(spark):
    template = [f"t{i}" for i in range(30)]
    items = [(i, " ".join([*template, *(f"own{i}w{j}" for j in range(20))])) for i in range(9)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    weights = [{g: w for b in decontamination.item_blocks(benchmark, max_bytes=n) for x in b.sizes for g, w in zip(x.known.tolist(), x.weight.tolist())} for n in (1 << 20, 2)]
    assert weights[0] == weights[1] and set(weights[0].values()) == {1 / 9, 1.0}
    text = " ".join([*(f"x{j}" for j in range(30)), *(f"own4w{j}" for j in range(20))])
    found = [[(b.ids[i].as_py(), round(s, 9)) for b in decontamination.item_blocks(benchmark, max_bytes=n) for i, _, _, s in b.matches(text)] for n in (1 << 20, 2)]
    assert found[0] == found[1]


def test_multi_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    stored = rng.integers(0, 1 << 64, 3000, np.uint64)
    prints = stored[rng.integers(0, 3000, 400)].copy()
    for i in range(len(prints)):
        for b in rng.choice(64, rng.integers(0, 24), replace=False).tolist():
            prints[i] ^= np.uint64(1 << b)
    index = decontamination.MultiIndex(stored)
    distance = np.bitwise_count(prints[:, None] ^ stored[None])
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(distance <= decontamination.RADIUS))))
    row, item = index.within(prints)
    assert set(zip(row.tolist(), item.tolist())) == want and len(row) == len(want)
    # the index is selective: few pairs meet in a block beside those within the radius
    met = {x for r, i in index.met(rng.integers(0, 1 << 64, 200, np.uint64)) for x in zip(r.tolist(), i.tolist())}
    assert len(met) < 0.06 * 200 * 3000


def test_decontamination_with_many_items_of_one_length():
    """Items with a shared template in one block: each document holds its own items alone, equal items each match, and repeated shingles count as often as in both."""
    rows_ = [(i, " ".join([*(f"t{j}" for j in range(12)), *(f"own{i}w{j}" for j in range(28))]), [4000] * 8 + [1] * 28) for i in range(4000)]
    rows_ += [(5000 + k, "same words in each of these items once more", [3] * 5) for k in range(3)]
    rows_ += [(6000, "a b c d e " * 4, [1] * 5)]
    from pyspark.sql.types import LongType

    index = decontamination.Index(rows_, LongType())
    of = lambda text: {index.ids[i].as_py(): (first, round(s, 6)) for i, first, _, s in index.matches(text)}
    assert of("x y z " + rows_[17][1] + " w") == {17: (3, 1.0)}
    assert of(" ".join(rows_[17][1].split()[:12])) == {}
    assert set(of(f"{rows_[5][1]} and {rows_[1234][1]}")) == {5, 1234}
    assert set(of("the same words in each of these items once more or less")) == {5000, 5001, 5002}
    assert of("a b c d e " * 9)[6000] == (0, 1.0) and of("a b c d e " * 2) == {}


def test_quality_classifier(spark, docs, empty):
    described = quality_classifier.described(docs)
    assert described.count() == docs.count()
    model = quality_classifier.train(described.select("x", (F.coalesce("doc_id", F.lit(0)) % 2).alias("label")))
    got = quality_classifier.score(described, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    one = quality_classifier.train(described.select("x", F.lit(1).alias("label")))
    assert all(r.score == 1 for r in quality_classifier.score(described, one).collect())
    none = quality_classifier.train(described.filter("false").select("x", F.lit(1).alias("label")))
    assert all(r.score == 0.5 for r in quality_classifier.score(described, none).collect())
    assert quality_classifier.score(quality_classifier.described(empty), model).count() == 0


def test_quality_classifier_equals_dense_formulas(spark):
    """Scores against class covariances and log densities written out with matrix inverses and determinants."""
    import numpy as np

    rng = np.random.default_rng(4)
    d = len(quality_classifier.STATISTICS)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) * 0.3 + y[:, None] * 0.2
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "doc_id bigint, x array<double>, label int").repartition(5)
    got = {r.doc_id: r.score for r in quality_classifier.score(df, quality_classifier.train(df)).collect()}
    spread = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    common = sum((y == c).mean() * spread[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        lean = max(0.2, d / (d + (y == c).sum()))
        s = (1 - lean) * spread[c] + lean * common
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-4 * np.eye(d)
        off = x - x[y == c].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(s), off) - 0.5 * np.linalg.slogdet(s)[1])
    odds = np.log((y == 1).mean() / (y == 0).mean()) + (logs[1] - logs[0]) / 3
    want = 1 / (1 + np.exp(-odds))
    assert max(abs(got[i] - want[i]) for i in range(400)) < 1e-9 and 0.05 < np.mean(list(got.values())) < 0.95


def test_quality_statistics():
    of = dict(zip(quality_classifier.STATISTICS, quality_classifier.statistics("One two!! two two\nOne two!! two two\n#x")))
    share = lambda k, n: (k / (n + 20)) ** 0.5
    import math

    assert of["words"] == math.log1p(9) and of["dup_lines"] == share(1, 3) and of["repeated"] == share(4, 9)
    assert of["same_next"] == share(2, 9) and of["mark_runs"] == share(2, 9) and of["symbols"] == share(1, 30) and of["marks"] == share(4, 30)
    assert quality_classifier.statistics(None) == quality_classifier.statistics("")


def brute_identify(text, model):
    """Language, score and rejection from plain loops over the centroids."""
    import math

    import numpy as np

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    raw = b" " + b" ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).encode().split()) + b" "
    counts = collections.Counter((int.from_bytes(raw[i : i + 2], "big") * 2654435761 & 0xFFFFFFFF) >> 20 for i in range(len(raw) - 1))
    counts.update(4096 + ((int.from_bytes(raw[i : i + 3], "big") * 2246822519 & 0xFFFFFFFF) >> 20) for i in range(len(raw) - 2))
    x = {k: math.log1p(n) * model.idf[k] for k, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    cosine = [sum(v / norm * float(c[k]) for k, v in x.items()) for c in model.centroids]
    best = int(np.argmax(cosine))
    return model.languages[best], cosine[best], 1 - cosine[best] > language_id.SLACK * model.radius[best]


def test_language_id(spark, docs, empty):
    model = language_id.train(docs.filter("lang is not null"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == got[18].lang_pred == "und"
    assert got[12].lang_pred in ("en", "fr") and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.train(empty) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_language_id_equals_brute_force(spark):
    """Predictions from plain loops; far texts are rejected, and of equal centroids the first language wins."""
    import random

    rnd = random.Random(6)
    words_of = {"aa": ["the", "and", "with", "house", "water"], "bb": ["der", "und", "mit", "haus", "wasser"], "cc": ["una", "con", "casa", "agua", "sol"]}
    texts = [(i, " ".join(rnd.choices(words_of[lang], k=40)) + rnd.choice([".", "!", " 12"]), lang) for i in range(120) for lang in words_of]
    df = spark.createDataFrame([(3 * i + k, t, lang) for k, (i, t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = language_id.train(df, centroids=3)
    assert model.languages == ["aa"] * 3 + ["bb"] * 3 + ["cc"] * 3
    more = spark.createDataFrame([(-1, "zzqx wvkj qqxz jjwq " * 9), (-2, None), (-3, "12 34"), (-4, "é ½ 日本 the house"), (-5, texts[0][1])], "doc_id bigint, text string")
    rows_ = df.select("doc_id", "text").unionByName(more)
    got = {r.doc_id: r for r in language_id.identify(rows_, model).collect()}
    for r in rows_.collect():
        lang, score, far = brute_identify(r.text, model)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-5 and got[r.doc_id].rejected == far
    assert got[-1].rejected and not got[-5].rejected
    same = spark.createDataFrame([(i, "the same text for both", lang) for i, lang in enumerate(("yy", "xx"))], "doc_id bigint, text string, lang string")
    tied = language_id.train(same)
    assert {r.lang_pred for r in language_id.identify(same, tied).collect()} == {"xx"}
    # of too many languages the most frequent are learned
    assert set(language_id.train(df.unionByName(same), languages=3).languages) == {"aa", "bb", "cc"}


def test_folds(spark, docs):
    from lodestone.llm.common import fold

    assert all(r.f == fold_of(r.doc_id, 5) for r in docs.select("doc_id", fold(F.col("doc_id"), 5).alias("f")).collect())
