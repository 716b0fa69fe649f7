"""The operators on awkward small tables, against plain Python."""

from __future__ import annotations

import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

from gleanery.llm import chat, decontaminate, licenses, line_dedup, mixing, near_dup, quality, sharding, spans, tokens  # noqa: E402
from gleanery.llm import queries as Q  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, id long, row string, __word int"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
BASE = [f"w{i}" for i in range(60)]
TEXTS = [
    (0, "One fine day, the line is long enough.\nshort\nOne fine day, the line is long enough."),
    (1, "  ONE fine day, the line is long enough.\t\nother words here stand"),
    (2, None),
    (3, ""),
    (4, " \n\t \n"),
    (5, LONG),
    (6, LONG + " tail"),
    (7, "Été À l'École, NAÏVE œuvre — we're 'tis they'll <|endoftext|> 12345 <|endoftext| ok"),
    (8, " ".join(BASE)),
    (9, " ".join([*BASE[:30], "changed", *BASE[31:]])),
    (10, " ".join(BASE)),
    (11, "a b c"),
    (12, "A B c"),
    (13, "Licensed under the Apache License, Version 2.0. cc by cc by mit license"),
    (14, "same words again and yet again they go on and on " * 12),
    (15, "emoji 👩‍👩‍👧 é 가 İstanbul ΣΑΣ 　 wide space x\u0085y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", 0, 7, "x", 1, "r", 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(docs, spark):
    """Repeated rows and null ids on top."""
    more = spark.createDataFrame([(None, "a null id, but a text that is long enough for a line\nOne fine day, the line is long enough.", None, None, 0, 7, "x", 1, "r", 2)] * 2, SCHEMA)
    return docs.unionByName(docs.where("doc_id in (0, 2, 8)")).unionByName(more)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: (r[0] is None, str(r)) if r[0] is None else (False, r[0]))


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))


def test_decontaminate(docs, spark, empty):
    items = [("b", " ".join(BASE[5:17])), ("a", "A-B c"), (None, "license version"), ("z", None), ("y", " .,"), ("x", " ".join(BASE[20:30])), ("a", "a b c")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.match(docs, bench)
    got = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0)
    same(got.collect(), brute.decontaminate(TEXTS, items))
    assert decontaminate.match(empty, bench).count() == 0
    assert decontaminate.match(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    index = decontaminate.build_index(docs)
    blocks = decontaminate.search(index, bench, block_words=7)
    one = decontaminate.search(index, bench)
    same(blocks.select("id", "n_words", "hits", "items").collect(), one.select("id", "n_words", "hits", "items").collect())
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r[0] for r in clean.select("doc_id").collect()} == {d for d, *_, bad in brute.decontaminate(TEXTS, items) if not bad}


def test_proximity(docs, spark):
    bench = spark.createDataFrame([("p", " ".join(reversed(BASE[3:9])))], "item_id string, text string")
    exact = decontaminate.match(docs, bench, slop=2)
    assert {r["doc_id"] for r in exact.where(F.size("near") > 0).collect()} == {8, 9, 10}
    assert exact.where(F.size("items") > 0).count() == 0


def test_decontaminate_on_random_words(spark, monkeypatch):
    """Few words, so that much matches: parts of items, blocks of parts, repeated rows, words that chunks cut, near matches."""
    import random

    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice(["", "1", "É"]) for _ in range(n))
    texts = [(i, some(rng.randrange(60))) for i in range(80)]
    long = some(300)
    texts += [(100, long), (101, "x" * 3000 + " " + long)]
    items = [(f"i{k}", some(rng.choice([1, 2, 3, 12]))) for k in range(20)] + [("long", long[5:]), ("i3", some(4)), ("word", "x" * 3000)]
    monkeypatch.setattr(decontaminate, "PART_WORDS", 50)
    monkeypatch.setattr(decontaminate.B, "CHUNK", 1000)
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    index = decontaminate.build_index(frame.unionByName(frame.where("doc_id = 100")))
    for words in (10**6, 60):
        found = decontaminate.search(index, bench, slop=3, block_words=words).collect()
        got = {(r["id"], r["n_words"], len(r["hits"]), len(r["items"]), bool(r["hits"])) for r in found}
        assert got == {(i, n, h, k, bad) for i, n, h, k, _, bad in brute.decontaminate(texts, items)}
        assert len(found) == len(texts) + 1
        want = {}
        for i, text in texts:
            w = brute.ALNUM.findall(brute.low(text))
            for item, x in items:
                x = brute.ALNUM.findall(brute.low(x))
                n = min(10, len(x))
                windows = [set(x[k : k + n]) for k in range(len(x) - n + 1)]
                if any(v <= set(w[k : k + n + 3]) for v in windows for k in range(len(w))):
                    want.setdefault(i, set()).add(item)
        assert {r["id"]: set(r["near"]) for r in found if r["near"]} == want


def test_quality_counts(docs, empty, odd):
    got = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(got.collect(), [(i, *brute.text_counts(t)) for i, t in TEXTS])
    assert quality.judge(empty).count() == 0
    assert quality.judge(odd).count() == odd.count()
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 8").count() == 2


def test_quality_rejects_outliers(spark):
    plain = [(i, " ".join(f"word{(i * 7 + k * k) % 91}" for k in range(60 + i % 20)), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(f"wo{(i * 5 + k * k) % 89}$$$" for k in range(70)), "en", "s") for i in range(20)]
    frame = spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")
    kept = {r[0] for r in quality.judge(frame).where("kept").select("doc_id").collect()}
    assert kept == {i for i, *_ in plain}


def test_quality_rejects_outliers_of_each_kind(spark):
    """One statistic far off at a time, and junk that is a source of its own."""
    import random

    rng = random.Random(3)
    words_ = lambda n: [f"word{rng.randrange(10**4)}" for _ in range(n)]
    letters = lambda n: ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(6)) for _ in range(n)]
    plain = [(i, " ".join(words_(60 + i % 20)), "en", "s") for i in range(300)]
    repeat = words_(10)
    junk = [
        (1000, " ".join("x" * 40 + w for w in words_(60))), (1001, " ".join(f"{w}$$$" for w in words_(60))), (1002, " ".join([*words_(300), *repeat, *words_(150), *(repeat * 13), *words_(20)])),
        (1003, "\n".join(rng.choice(repeat) for _ in range(200))), (1004, " ".join(letters(20))),
    ]
    tiny = [(2000 + i, " ".join(f"{w}$$$" for w in words_(70)), "en", "tiny") for i in range(3)]
    frame = spark.createDataFrame([*plain, *[(*r, "en", "s") for r in junk], *tiny], "doc_id long, text string, lang string, source string")
    out = quality.judge(frame)
    assert out.where("doc_id >= 1000 and base_failed").count() == 0
    assert {r[0] for r in out.where("kept").select("doc_id").collect()} == {i for i, *_ in plain}


@pytest.mark.parametrize("many", [quality.MANY, 0])
def test_quality_verdict(spark, sf_dir, monkeypatch, many):
    """Every distance and verdict, with estimates broadcast and joined; sources and languages of all sizes, equal rows, a group without spread."""
    monkeypatch.setattr(quality, "MANY", many)
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = [(5000 + k, "one text that a whole source repeats, with enough words to pass all of the base rules of quality here", "en", "copies") for k in range(60)]
    more += [(6000 + k, " ".join(f"w{(k * j) % 37}$" for j in range(40)), None if k % 2 else "xx", "few") for k in range(6)]
    frame = frame.unionByName(spark.createDataFrame(more, frame.schema))
    want = brute.outliers([tuple(r) for r in frame.collect()])
    got = {r["doc_id"]: r for r in quality.judge(frame).collect()}
    assert {d: r["kept"] for d, r in got.items()} == {d: kept for d, (_, kept) in want.items()}
    assert all((r["distance2"] is None) == (want[d][0] is None) and (r["distance2"] is None or r["distance2"] == pytest.approx(want[d][0], rel=1e-6, abs=1e-9)) for d, r in got.items())
    assert 0 < sum(not kept for _, kept in want.values()) < len(want) / 2


def test_line_dedup(docs, empty, odd):
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    same(got.collect(), brute.line_dedup(TEXTS))
    assert line_dedup.dedup_lines(empty).count() == 0
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count()
    assert [r["n_dropped"] for r in out.where("doc_id is null").collect()] == [1, 1]
    assert [r["n_dropped"] for r in out.where("doc_id = 0").collect()] == [0, 0]


def test_line_bitmaps_rebuild_the_text(docs):
    out = line_dedup.dedup_lines(docs).join(docs.select("doc_id", "text"), "doc_id")
    again = out.select(line_dedup.apply_runs(F.split(F.coalesce("text", F.lit("")), "\n"), F.col("keep")).alias("a"), "kept_text")
    assert again.where("a != kept_text").count() == 0


def test_near_dup(docs, empty, odd):
    got = near_dup.cluster(docs).select("doc_id", "n_shingles", "component_id", "kept")
    same(got.collect(), brute.near_dup(TEXTS))
    assert near_dup.cluster(empty).count() == 0
    assert near_dup.cluster(odd).count() == odd.count()
    kept = near_dup.keep_firsts(odd)
    assert kept.columns == odd.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(8) == 1 and 9 not in ids and 10 not in ids


def test_near_dup_reopens_buckets(spark):
    """Links between members of a bucket whose first member is linked to neither."""
    import random

    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(12):
        base = [f"t{rng.randrange(10**6)}" for _ in range(220)]
        for drift in range(9):
            w = list(base)
            for _ in range(drift * 3):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    got = near_dup.cluster(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept")
    same(got.collect(), brute.near_dup(rows))


def test_texts_of_one_long_word_or_line(spark):
    """No operator depends on words or lines being short; chunks cut such words."""
    word, line = "x" * 1_200_000, "one two three four five six seven " * 60_000
    texts = [(1, word), (2, word), (3, line), (4, line + "eight"), (5, f"{word} tail of words"), (6, "plain words in a short text")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = near_dup.cluster(frame).select("doc_id", "n_shingles", "component_id").collect()
    want = brute.near_dup(texts)
    assert {tuple(r) for r in got} == {r[:3] for r in want}
    bench = spark.createDataFrame([("w", word), ("l", "five six seven one two three four five six seven one"), ("z", "tail of words")], "item_id string, text string")
    found = {r["doc_id"]: sorted(r["items"]) for r in decontaminate.match(frame, bench, slop=1).collect()}
    assert found == {1: ["w"], 2: ["w"], 3: ["l"], 4: ["l"], 5: ["w", "z"], 6: []}
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(frame).collect()} == {d: len(t.split()) for d, t in texts}
    removed = {r["doc_id"]: (r["n_words"], r["n_removed_words"]) for r in spans.remove_repeats(frame).collect()}
    assert removed[1] == (1, 0) and removed[6] == (6, 0) and removed[4][1] > 0.99 * removed[4][0]
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(frame).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}
    assert licenses.scan(frame).count() == 6 and sharding.shard(frame, 2).count() == 6
    index, n = tokens.counter(Q.tokenizer_path()).index(word[:50_000])
    assert n == library_counts([word[:50_000]])[0] and len(tokens.prefix_counts(index)) == 50_000


def least_linked(texts):
    """The links between texts and the least place that links reach, by all pairs."""
    import numpy as np

    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    place = {g: k for k, g in enumerate({g for s in sets for g in s})}
    has = np.zeros((len(sets), len(place)), np.float32)
    for k, s in enumerate(sets):
        has[k, [place[g] for g in s]] = 1
    both, n = has @ has.T, has.sum(axis=1)
    link = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    want = np.arange(len(texts))
    while True:
        least = np.where(link, want[None, :], len(texts)).min(axis=1)
        if (least == want).all():
            return link, want
        want = least


def test_near_dup_finds_the_hub_of_a_crowd(spark):
    """2000 edited copies that are linked through the one text in their middle only."""
    import random

    import numpy as np

    rng = random.Random(11)
    base = [f"t{k}" for k in range(220)]
    rows = []
    for n in range(2001):
        w = list(base)
        for k in rng.sample(range(22), 6) if n != 1000 else []:
            w[k * 10 + rng.randrange(5)] = f"n{rng.randrange(10**6)}"
        rows.append((n, " ".join(w)))
    link, want = least_linked([t for _, t in rows])
    assert (link[1000].sum(), np.delete(np.delete(link, 1000, 0), 1000, 1).sum() - 2000) == (2001, 0)
    got = near_dup.cluster(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id")
    same(got.collect(), enumerate(want.tolist()))


def test_near_dup_in_a_crowd_of_like_texts(spark):
    """1500 texts of the same 40 blocks, about 28 in each: all meet in buckets, few are linked."""
    import random

    rng = random.Random(8)
    blocks = [" ".join(f"b{k}x{j}" for j in range(20)) for k in range(40)]
    texts = [" ".join(b for b in blocks if rng.random() < 0.7) for _ in range(1500)]
    link, want = least_linked(texts)
    merges = len(texts) - len(set(want.tolist()))
    assert (link.sum() - len(texts)) // 2 > 100 and 100 < merges < 1000
    got = near_dup.cluster(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "component_id")
    same(got.collect(), enumerate(want.tolist()))


def test_near_dup_blocks_of_a_bucket(spark, monkeypatch):
    """Buckets split into tiers and blocks give the same links; so do rows without an id, which are one document."""
    import random

    rng = random.Random(9)
    blocks = [" ".join(f"b{k}x{j}" for j in range(9)) for k in range(40)]
    texts = [" ".join(b for b in blocks if rng.random() < 0.4 + 0.5 * (n % 7) / 7) for n in range(300)]
    _, want = least_linked(texts)
    monkeypatch.setattr(near_dup, "BLOCK", 1 << 13)
    monkeypatch.setattr(near_dup, "ROUNDS", 0)
    monkeypatch.setattr(near_dup, "FEW", 0)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dup.cluster(frame).select("doc_id", "component_id")
    same(got.collect(), enumerate(want.tolist()))
    nulls = frame.where("doc_id % 3 = 0").selectExpr("cast(null as long) doc_id", "text")
    got = near_dup.cluster(frame.where("doc_id % 3 > 0").unionByName(nulls))
    assert got.count() == 300
    root = dict(got.where("doc_id is not null").select("doc_id", "component_id").collect())
    assert {r[0] for r in got.where("doc_id is null").select("component_id").collect()} == {min(root[d] for d in root if want[d] in set(want[::3]))}


def test_near_dup_on_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = near_dup.cluster(frame).select("doc_id", "n_shingles", "component_id", "kept")
    same(got.collect(), brute.near_dup([tuple(r) for r in frame.select("doc_id", "text").collect()]))


def test_spans(spark, empty, odd):
    passage = "The river rose in the night and took the bridge. Nobody had thought that it could come so high. We went up the hill with what we had."
    texts = [
        (1, f"First words of one text. {passage} It ends here with words of its own."),
        (2, f"Another text begins in its own way, which is long. {passage} Then it goes on."),
        (3, "Nothing in here stands anywhere else. That is all there is to say about it today, and no more of it."),
        (4, f"{passage}\nline one here\n{passage}"),
        (5, None),
    ]
    got = {r["doc_id"]: r for r in spans.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["text"] == texts[0][1] and got[3]["n_removed"] == 0 and got[5]["text"] == ""
    assert got[2]["text"] == "Another text begins in its own way, which is long. Then it goes on."
    assert got[4]["text"] == "line one here\n" and got[4]["n_removed_words"] == 2 * len(passage.split())
    assert [got[k]["first_ids"] for k in (1, 2, 3, 4)] == [[], [1], [], [1]] and [got[k]["changed"] for k in (1, 2)] == [False, True]
    assert spans.remove_repeats(empty).count() == 0
    out = spans.remove_repeats(odd)
    assert out.count() == odd.count()


def chosen(word):
    import numpy as np
    import pyarrow as pa

    from gleanery.llm import _bytes as B

    if word not in _chosen:
        h = B.tokens(*B.buffer(pa.array([word])), B.BY_SPACE)[2]
        _chosen[word] = bool((h[0] & np.uint64(7)) == 0)
    return _chosen[word]


_chosen = {}


def brute_spans(docs):
    """Removed sentences by document, with sentences found by plain string work."""
    import re

    seen, cut = {}, {}
    for doc, text in sorted(docs):
        words, firm, soft = [], set(), set()
        for line in (text or "").split("\n"):
            for w in re.findall(r"[^\x20\x09-\x0D]+", line):
                words.append(w)
                if re.search(r"[.!?][\"')\]}]?$", w) or chosen(w):
                    firm.add(len(words))
            soft.add(len(words))
        firm |= {len(words)} - {0}
        for lo, hi in zip([0, *sorted(firm)], sorted(firm), strict=False):
            if hi - lo > spans.LONG:
                firm |= set(range(lo + spans.STEP, hi, spans.STEP))
        edges = [0, *sorted((firm | soft) - {0})]
        cut[doc] = sentences = list(zip(edges, edges[1:], strict=False))
        for i, (lo, _) in enumerate(sentences):
            ends = sorted(e for e in firm if e > lo)
            ends = [e for k, e in enumerate(ends) if k >= spans.MIN_SENTENCES - 1 and e - lo >= spans.MIN_WORDS]
            if ends:
                seen.setdefault(tuple(brute.low(w) for w in words[lo : ends[0]]), []).append((doc, i, edges.index(ends[0]) - 1))
    gone = defaultdict(set)
    for v in seen.values():
        for doc, i, j in sorted(v)[1:]:
            gone[doc] |= set(range(i, j + 1))
    size = lambda x: x[1] - x[0]
    return [(d, len(s), len(gone[d]), sum(map(size, s)), sum(size(s[k]) for k in gone[d])) for d, s in cut.items()]


def test_spans_in_the_middle_and_wrapped(spark):
    """Passages of 60 words that begin and end within sentences, wrapped in one text and not in the other."""
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) + ("." if rng.random() < 0.06 else "")
    texts = []
    for k in range(150):
        passage = [word() for _ in range(60)]
        wrapped = "\n".join(" ".join(passage[i : i + 7]) for i in range(0, 60, 7))
        texts += [(2 * k, " ".join([*[word() for _ in range(33)], *passage, *[word() for _ in range(20)]])), (2 * k + 1, " ".join([word() for _ in range(12)]) + f" {wrapped} " + " ".join([word() for _ in range(40)]))]
    texts += [(1000 + k, " ".join(word() for _ in range(200))) for k in range(100)]
    got = spans.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"))
    same(got.select("doc_id", "n_sentences", "n_removed", "n_words", "n_removed_words").collect(), brute_spans(texts))
    removed = {r["doc_id"]: r["n_removed_words"] for r in got.collect()}
    second = [removed[2 * k + 1] for k in range(150)]
    assert sum(n > 0 for n in second) >= 149 and sum(second) >= 0.8 * 60 * 150
    assert all(not n for d, n in removed.items() if d % 2 == 0 or d >= 1000)


def test_spans_on_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = spans.remove_repeats(frame).select("doc_id", "n_sentences", "n_removed", "n_words", "n_removed_words")
    same(got.collect(), brute_spans([tuple(r) for r in frame.select("doc_id", "text").collect()]))


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, empty, odd):
    got = tokens.prefix_index(docs, Q.tokenizer_path()).select("doc_id", "n_bytes", "n_tokens")
    same(got.collect(), [(i, len((t or "").encode()), n) for (i, t), n in zip(TEXTS, library_counts([t or "" for _, t in TEXTS]), strict=True)])
    assert tokens.prefix_index(empty, Q.tokenizer_path()).count() == 0
    assert tokens.prefix_index(odd, Q.tokenizer_path()).count() == odd.count()


def test_every_prefix():
    own = tokens.counter(Q.tokenizer_path())
    for text in [t for _, t in TEXTS if t and len(t) < 800] + ["aaaaaaaaaaaaaaaaaaaa bbb", "can't we're I'LL d'accord x'y 's'", "ñandú¿qué? 12ab34--'s !!<|startoftext|>!!"]:
        index, n = own.index(text)
        want = library_counts([text[:k] for k in range(1, len(text) + 1)])
        assert tokens.prefix_counts(index).tolist() == want and n == want[-1]
        assert tokens.longest_prefix(index, 5) == max((k + 1 for k, c in enumerate(want) if c <= 5), default=0)
        assert tokens.tokens_at(index, 3) == want[2]


def test_prefix_index_columns(docs):
    out = tokens.prefix_index(docs, Q.tokenizer_path()).where("doc_id = 8")
    r = out.select(tokens.tokens_in_prefix(F.col("prefix_index"), F.lit(7)).alias("n"), tokens.chars_within(F.col("prefix_index"), 4).alias("c")).first()
    text = dict(TEXTS)[8]
    assert r["n"] == library_counts([text[:7]])[0]
    assert library_counts([text[: r["c"]]])[0] <= 4 < library_counts([text[: r["c"] + 1]])[0]


def test_prefixes_fuzz():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    own = tokens.counter(Q.tokenizer_path())

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.sampled_from("abetnrs 'IéÉñ中1.,-!\ńßΣİ<|>"), max_size=40))
    def check(text):
        counts = tokens.prefix_counts(own.index(text)[0]).tolist()
        assert counts == (library_counts([text[:k] for k in range(1, len(text) + 1)]) if text else [])

    check()


def test_prefixes_of_long_pieces():
    """Pieces of 600 to 5000 characters with marks to be composed, special strings, runs of signs, Hangul letters."""
    import random

    rng = random.Random(6)
    bits = ["e\u0301", "a", "b", "\u0301\u0323", "<|endoftext|>", "<|endoftext|", "'", "'re", "re\u0301", "\u1112\u1161\u11ab", "!", "...", "7", "\u3000", "\u0130", "\u03a3", "\u00e9", "\U0001f469\u200d", "\u0378", "<|startoftext|>"]
    own = tokens.counter(Q.tokenizer_path())
    pieces = ["e\u0301ab" * 300, "x<|endoftext|>" + "abc" * 300, "z" + "\u0301\u0323\u0316" * 40, "!" * 700 + "\u0338" * 3 + "=\u0338" * 20]
    pieces += ["".join(rng.choice(bits) for _ in range(n)) for n in (600, 1500, 2500)]
    pieces += ["".join(rng.choice(bits[:k]) for _ in range(900)) for k in (1, 4, 8)] + ["".join(rng.choices(bits, k=12)) for _ in range(60)]
    for piece in pieces:
        text = f"Before {piece} after"
        index, n = own.index(text)
        got = tokens.prefix_counts(index)
        cuts = sorted({*rng.sample(range(1, len(text) + 1), min(250, len(text))), len(text)})
        assert [int(got[k - 1]) for k in cuts] == library_counts([text[:k] for k in cuts]), piece[:40]
        assert n == got[-1] and len(got) == len(text)


def test_sharding(docs, empty, odd, spark, tmp_path):
    for frame in (docs, odd):
        out = sharding.shard(frame, 3, keep=False)
        got = out.collect()
        assert len(got) == frame.count()
        places = defaultdict(list)
        for r in got:
            places[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in places.values())
    text = dict(TEXTS)
    for r in sharding.shard(docs, 3, keep=False).collect():
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard(empty, 3).count() == 0
    kept = sharding.shard(docs, 2)
    assert {"text", "lang", "shard", "slot"} <= set(kept.columns) and len(set(kept.columns)) == len(kept.columns)


def test_sharding_without_ids(spark):
    """Rows that share an id, or have none, are spread by their texts."""
    frame = spark.createDataFrame([(None if k % 2 else 7, f"text number {k} " + "x" * (k % 9)) for k in range(4000)], "doc_id long, text string")
    per = sharding.shard(frame, 8, keep=False).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    load = [r["b"] for r in per]
    assert len(load) == 8 and max(load) <= 1.02 * sum(load) / 8


def test_slot_map_versions(spark, tmp_path):
    load = {s: (s * 37) % 101 + 1 for s in range(512)}
    first = sharding.make_map(load, 8, 512)
    total = lambda m, n: [sum(load[s] for s in range(512) if m[s] == k) for k in range(n)]
    assert max(total(first, 8)) - min(total(first, 8)) <= 2
    load.update({s: load[s] * 3 for s in range(0, 512, 16)})
    second = sharding.rebalance(first, load, 8)
    assert max(total(second, 8)) <= 1.03 * sum(load.values()) / 8
    assert sum(a != b for a, b in zip(first, second, strict=True)) < 200
    third = sharding.rebalance(second, load, 9)
    assert max(total(third, 9)) <= 1.05 * sum(load.values()) / 9
    assert sum(a != b for a, b in zip(second, third, strict=True)) < 120
    fewer = sharding.rebalance(third, load, 7)
    assert set(fewer) == set(range(7))
    for version, m in enumerate((first, second), 1):
        sharding.save_map(spark, str(tmp_path / "map"), version, m)
    assert [r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), 2).orderBy("vslot").collect()] == second
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.save_map(spark, str(tmp_path / "map"), 1, first)


def targets(sizes, weights, cap=3):
    """sizes: by source in order; excess is shared anew until none is above its cap."""
    left, out, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] > cap * sizes[k]]
        if not over:
            for k in free:
                out[k] = share[k]
            return out
        for k in over:
            out[k] = float(cap * sizes[k])
            left -= out[k]
            free.remove(k)
    return out


def test_mixing(spark, empty, odd):
    rows_ = [(i, " ".join(["w"] * (1 + i * 7 % 40)), [None, "a", "b", "c", "d"][0 if i % 50 == 0 else 1 + (i % 4 if i % 9 else 0)]) for i in range(600)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    out = mixing.assign(frame).collect()
    size = defaultdict(int)
    for _, t, s in rows_:
        size[s] += len(t.split())
    order = sorted((s for s in size if s), key=str.encode) + [None]
    want = dict(zip(order, targets([size[s] for s in order], [1 + k % 3 for k in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["n_takes"]
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    again = mixing.assign(frame.repartition(5))
    same(again.select("doc_id", "taken", "positions").collect(), [(r["doc_id"], r["taken"], r["positions"]) for r in out])
    ordered = mixing.in_training_order(frame, mixing.assign(frame))
    assert ordered.count() == sum(r["n_takes"] for r in out) and ordered.columns == frame.columns
    assert mixing.assign(empty).count() == 0
    assert mixing.assign(odd).count() == odd.count()
    assigned = mixing.assign(odd)
    assert mixing.in_training_order(odd, assigned).count() == assigned.agg(F.sum("n_takes")).first()[0]


def test_mixing_follows_the_schedule(spark):
    frame = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    out = mixing.assign(frame, weights=(1.0, 1.0), slopes=(-0.8, 0.8))
    at = out.select("source", F.explode("positions").alias("p"))
    early = {r["source"]: r["n"] for r in at.where("p < 0.25").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert early["a"] == pytest.approx(2000 * 0.4, rel=0.02) and early["b"] == pytest.approx(2000 * 0.1, rel=0.05)


def test_licenses(docs, empty, odd):
    got = licenses.scan(docs).collect()
    same([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], [(i, *brute.phrases(t)) for i, t in TEXTS])
    by = {r["doc_id"]: r for r in got}
    assert by[13]["labels"] == "apache,cc-by,mit" and by[13]["score"] == 1.0 and by[0]["score"] == 0.0
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd).count() == odd.count()


def test_license_with_changed_words(spark):
    text = licenses.TEMPLATES["isc"][0].split()
    text = ["before", "it", *text[:9], "really", *text[9:20], *text[21:], "after"]
    out = licenses.scan(spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[5:12]))], "doc_id long, text string")).collect()
    by = {r["doc_id"]: r for r in out}
    assert by[1]["labels"] == "isc" and by[1]["score"] > 0.7 and by[2]["labels"] == ""


TURNS = [
    (1, 0, "system", "be <|im_end|> kind"), (1, 2, "assistant", "<|im_start|>assistant ok<\\|x"), (1, 1, "user", None), (1, 3, None, "no role"),
    (2, 0, "user\n%0A", "<"), (2, 1, "assistant", "ends with <"), (2, 2, "assistant", ""), (2, 3, "assistant", "two <\\\\| <| in\n\na row |>"), (None, None, "user", "null id"), (3, 0, "assistant", "a" * 100_000),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("messages", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(chat.format_chats(turns)).collect()}
    assert got == brute.chat([(c, -1 if t is None else t, r, x) for c, t, r, x in TURNS])
    assert chat.digest(chat.format_chats(turns.limit(0))).count() == 0
    assert "<|im_end|> kind" not in chat.format_chats(turns).where("conv_id = 1").first()["formatted"].replace("<|im_end|>\n", "")


def test_template_language():
    render = chat.compile_template("{% set n = 'x' ~ 1 %}{%- for m in ms -%} {% if loop.first %}[{{ m.a | upper }}]{% elif m['a'] in 'bc' and not m.b %}{{ n }}{% else %}{% generation %}{{ m.a + '!' }}{% endgeneration %}{% endif %}{% endfor %}")
    text, marks = render({"ms": [{"a": "q"}, {"a": "b"}, {"a": "zz", "b": True}]})
    assert text == "[Q]x1zz!" and [text[a:b] for a, b in marks] == ["zz!"]
    folded = chat.fold(chat.parse("a{{ 'b' ~ ('c' | upper) }}{% if 1 == 2 %}no{% elif true %}d{% endif %}{{ x }}"))
    assert folded == ("block", [("text", "abCd"), ("show", ("name", "x"))])
    for bad in ("{{ __class__ }}", "{{ x.__class__ }}", "{{ x | eval }}", "{% for x in 3 %}", "{% endif %}", "{{ 1 + }}", "{{ x() }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)({"x": "s"})
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{% for c in x %}{% endfor %}")({"x": "text"})
