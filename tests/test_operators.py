"""Corpus operators on small tables with known results."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gleanery.config import ScanConfig, excluded, from_mapping, glob_regex, load_config, should_exclude
from gleanery.functions.paths import depth, extension, parent
from gleanery.functions.wilson import auto_rate, wilson_ci
from gleanery.operators import dedup, encoding, health, inventory, language, minhash, pii, sampling, semantic, simhash, text_quality
from gleanery.plans import corpus as C


def texts(spark, *values, **more):
    rows = [(k, v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, text string").withColumn("size", F.octet_length("text").cast("long"))


@pytest.mark.parametrize(
    ("path", "ext"),
    [("a/b.TXT", ".txt"), ("x.tar.gz", ".gz"), (".bashrc", "(no extension)"), ("a/.h.json", ".json"), ("plain", "(no extension)"), ("end.", "(no extension)"), ("a.b/c", "(no extension)")],
)
def test_extension(spark, path, ext):
    assert spark.range(1).select(extension(F.lit(path))).first()[0] == ext


def test_parent_and_depth(spark):
    r = spark.range(1).select(parent(F.lit("a/b/c.txt")), parent(F.lit("c.txt")), depth(F.lit("a/b/c.txt"))).first()
    assert tuple(r) == ("a/b", ".", 2)


@pytest.mark.parametrize("pattern", ["*.bin", ".git", "a?c", "[a-c]*", "[!x]y", "nested", "*/deep/*", "no[", "a.b", "x+y"])
def test_globs_agree_on_driver_and_cluster(spark, pattern):
    paths = ["large.bin", "a/large.bin", ".git/x", "abc", "cat/z", "xy", "ay", "nested/deep/file.txt", "no[", "a.b", "aXb", "x+y", "nestedx"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["x"] for r in frame.select("path", excluded(F.col("path"), [pattern]).alias("x")).collect()}
    assert got == {p: should_exclude(p, [pattern]) for p in paths}
    assert glob_regex(pattern).startswith("(?s)^")


def test_config(tmp_path):
    assert load_config(str(tmp_path)) == ScanConfig()
    (tmp_path / ".gleanery.yaml").write_text("exclude: ['*.bin']\nsampling: {rate: 7, min_per_type: 3}\nsimhash: {bits: 128, threshold: 500}\nthresholds: {pii_critical: -1}\npii: {custom_patterns: [{name: a, pattern: 'x+'}, {name: b, pattern: '('}]}\n")
    with pytest.warns(UserWarning, match="not valid"):
        c = load_config(str(tmp_path))
    assert c.exclude[-1] == "*.bin" and ".git" in c.exclude
    assert (c.sampling_rate, c.sampling_rate_auto, c.sampling_min_per_type) == (1.0, False, 3)
    assert (c.simhash_bits, c.simhash_threshold, c.pii_critical) == (128, 128, 0.0)
    assert c.pii_custom_patterns == (("a", "x+"),)
    assert from_mapping([1]) == ScanConfig()
    (tmp_path / ".gleanery.yaml").write_bytes(b"\xff\xfe: [")
    with pytest.warns(UserWarning, match="defaults"):
        assert load_config(str(tmp_path)) == ScanConfig()


def test_size_buckets_are_filled(spark):
    frame = spark.createDataFrame([(0,), (1023,), (1024,), (5 * 1024 * 1024,)], "size long")
    got = [(r["label"], r["n"]) for r in inventory.size_histogram(frame).orderBy("bucket_ord").collect()]
    assert got == [("<1 KB", 2), ("1-10 KB", 1), ("10-100 KB", 0), ("100 KB-1 MB", 0), ("1-10 MB", 1), ("10-100 MB", 0), (">100 MB", 0)]


def test_future_times_are_in_no_bucket(spark):
    frame = spark.sql("SELECT timestamp'2024-01-02 00:00:00' AS t UNION ALL SELECT timestamp'2023-12-30 00:00:00' UNION ALL SELECT timestamp'2020-01-01 00:00:00'")
    got = {r["label"]: r["n"] for r in inventory.age_histogram(frame, "t", F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()}
    assert got["1-7 days"] == 1 and got[">1 year"] == 1 and sum(got.values()) == 2


def test_dedup(spark):
    h = dedup.hashed(texts(spark, "aaa", "aaa", "aaa", "bb", "bb", "c"))
    r = dedup.dedup_summary(h).first()
    assert (r["total_hashed"], r["unique_files"], r["duplicate_groups"], r["duplicate_files"], r["duplicate_bytes"]) == (6, 1, 2, 5, 8)
    assert r["duplicate_pct"] == pytest.approx(83.3333)
    assert dedup.dedup_summary(h.limit(0)).first()["duplicate_pct"] == 0
    assert [x["first_id"] for x in dedup.top_groups(h, 1).collect()] == [0]


def test_text_health(spark):
    got = [(r["status"], r["is_degraded"]) for r in health.text_health(texts(spark, "", "x" * 50, "x" * 51, "�" * 30 + "y" * 60, None)).orderBy("id").collect()]
    assert got == [("empty", False), ("near_empty", False), ("ok", False), ("ok", True), ("unreadable", False)]


@pytest.mark.parametrize(("n", "rate"), [(0, 1.0), (100, 1.0), (1000, 1.0), (3000, 1.0), (50_000, 0.06), (500_000, 0.006), (1_000_000, 0.003)])
def test_auto_rate(spark, n, rate):
    assert spark.range(1).select(auto_rate(F.lit(n))).first()[0] == pytest.approx(rate)


def test_wilson(spark):
    ci = lambda k, n, pop: spark.range(1).select(wilson_ci(F.lit(k), F.lit(n), F.lit(pop)).alias("c")).first()["c"]
    c = ci(50, 100, 1000)
    assert 0 < c["lo"] < 0.5 < c["hi"] < 1
    assert tuple(ci(30, 100, 100)) == (0.3, 0.3, 0.3) and ci(0, 100, 1000)["hi"] > 0 and tuple(ci(0, 0, 100)) == (0, 0, 0)


def literal_allocation(dirs: dict[str, int], target: int) -> dict[str, int]:
    total, left, out = sum(dirs.values()), target, {}
    for d in sorted(dirs):
        out[d] = max(0, min(max(1, round(dirs[d] / total * target)), dirs[d], left))
        left -= out[d]
    for d in sorted(dirs, key=lambda d: (-dirs[d], d)):
        more = min(left, dirs[d] - out[d])
        out[d] += more
        left -= more
    return out


def test_directory_allocation(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for m in range(12):
        dirs = {f"d{k}": rng.randrange(1, 40) for k in range(rng.randrange(1, 9))}
        n = sum(dirs.values())
        target = min(n, max(math.ceil(n * 0.2), min(5, n)))
        want |= {(f"m{m}", d): a for d, a in literal_allocation(dirs, target).items()}
        rows += [(f"m{m}", d) for d, k in dirs.items() for _ in range(k)]
    frame = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], "id long, mime string, cluster string, size long")
    got = {(r["mime"], r["cluster"]): r["alloc"] for r in sampling.directory_allocation(frame, 0.2, 5).collect()}
    assert got == want
    assert sampling.directory_sample(frame, 0.2, 5).count() == sum(want.values())


def test_stratified_sample(spark):
    frame = spark.createDataFrame([(k, "a" if k < 400 else "b" if k < 410 else None) for k in range(412)], "id long, mime string")
    got = {r["mime"]: r["n"] for r in sampling.stratified_sample(frame, 0.25, 30).groupBy("mime").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 100, "b": 10, None: 2}
    one = {r[0] for r in sampling.stratified_sample(frame, 0.25, 30).select("id").collect()}
    assert one == {r[0] for r in sampling.stratified_sample(frame.repartition(7), 0.25, 30).select("id").collect()}
    assert sampling.stratified_sample(frame, 1.0).count() == 412


def test_design_effect(spark):
    same = spark.createDataFrame([(k % 4, 10 ** (k % 4 + 1)) for k in range(40)], "cluster long, size long")
    assert sampling.design_effect(same).first()["deff"] == pytest.approx(10.0)
    assert sampling.design_effect(same.where("cluster = 1")).first()["deff"] == 1.0
    assert sampling.design_effect(same.limit(0)).first()["deff"] == 1.0


VALID = {
    "credit_card": ["4111111111111111", "5500000000000004", "340000000000009", "6011000000000004", "4111 1111 1111 1111", "4111-1111-1111-1111"],
    "ssn": ["123-45-6789", "456-78-1234"], "phone": ["555-123-4567", "(555) 123-4567"], "ip_address": ["192.168.1.100", "10.0.0.1"], "iban": ["DE89370400440532013000", "GB29NWBK60161331926819"],
    "uk_nino": ["AB123456C"], "de_tax_id": ["86095742719"], "es_dni": ["12345678Z"], "email": ["a.b+c@example.co.uk"], "ipv6_address": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"],
    "btc_address": ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"], "eth_address": ["0x" + "aB" * 20],
}
INVALID = {
    "credit_card": ["4111111111111112", "1234567890123456"], "ssn": ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "123456789", "12-345-6789", "078-05-1120"], "phone": ["12345", "x555-123-4567"],
    "ip_address": ["999.999.999.999"], "iban": ["DE00370400440532013000", "GB00"], "uk_nino": ["DF123456A"], "de_tax_id": ["00000000000"], "es_dni": ["12345678A"], "email": ["a@b"], "eth_address": ["0x12"],
}


def test_pii_patterns(spark):
    cases = [(name, v, good) for good, table in ((1, VALID), (0, INVALID)) for name, vs in table.items() for v in vs]
    frame = spark.createDataFrame([(k, f"see {v} here") for k, (_, v, _) in enumerate(cases)], "id long, text string")
    found = {(r["id"], r["pattern"]) for r in pii.count_matches(frame).collect()}
    wrong = [(name, v) for k, (name, v, good) in enumerate(cases) if ((k, name) in found) != bool(good)]
    assert not wrong


def test_pii_lines_positions_and_confidence(spark):
    text = "first\nSocial Security Number: 123-45-6789\nOrder reference: 123-45-6789\n123-45-6789 and a@b.org, c@d.org\nPlease call 555-123-4567"
    got = pii.scored_matches(texts(spark, text)).collect()
    ssn = {r["line_no"]: r for r in got if r["pattern"] == "ssn"}
    assert ssn[2]["confidence"] >= 0.6 and ssn[3]["confidence"] <= 0.4 and ssn[4]["confidence"] == 0.5
    assert (ssn[2]["start"], ssn[3]["start"], ssn[4]["start"]) == (24, 17, 0)
    assert [r["start"] for r in sorted((r for r in got if r["pattern"] == "email"), key=lambda r: r["start"])] == [16, 25]
    assert next(r for r in got if r["pattern"] == "phone")["confidence"] > 0.4
    assert pii.scored_matches(texts(spark, text), 0.55).where("pattern = 'ssn'").count() == 1
    custom = pii.patterns_with((("badge", "B-[0-9]+"),))
    assert [(r["pattern"], r["n"]) for r in pii.count_matches(texts(spark, "B-1 B-2\nB-3"), custom).collect()] == [("badge", 3)]


SENTENCES = {
    "English": "The house of the family is near the river and it was built for them", "Spanish": "La casa de la familia que está en el campo es para los niños", "French": "La maison de la famille est dans le village et les enfants jouent",
    "German": "Das Haus der Familie ist nicht weit von dem Fluss und die Kinder spielen", "Italian": "La casa della famiglia non è nel paese che il padre amava di più", "Russian": "Это дом на реке и не что как он по улице",
    "Japanese": "これは日本語の文章です。とても長いです。日本の家。", "Korean": "이것은 한국어 문장입니다 그리고 아주 긴 문장입니다 그래요", "CJK": "这是一个中文句子我们住在河边的房子里面非常好看的地方", "Unknown": "short",
    "Thai": "นี่คือประโยคภาษาไทยที่ยาวพอสมควรสำหรับการทดสอบ", "Latin (Unknown)": "zzyx qwrt plmk vbnm ghjk tyui wert sdfg",
}


def test_languages(spark):
    names = list(SENTENCES)
    got = {r["id"]: r["language"] for r in language.detect(texts(spark, *SENTENCES.values())).collect()}
    assert {names[k]: v for k, v in got.items()} == {n: n for n in names}


def test_filter_on_language(spark):
    frame = language.detect(texts(spark, *SENTENCES.values()))
    assert frame.where("language = 'German' or language = script").join(frame.where("script = 'Thai'").select("id"), "id").count() == 1


def test_mixed_script_and_ties(spark):
    half = "абвгдежзик" + "abcdefghij"
    got = [r["script"] for r in language.detect(texts(spark, half + " !", half[::-1] + " !", "абвгдежз abcdefgh กขฃคฅฆงจฉ")).orderBy("id").collect()]
    assert got == ["Cyrillic", "Latin", "Mixed Script"]


def test_prior(spark):
    frame = lambda *ls: spark.createDataFrame([(k, v, "") for k, v in enumerate(ls)], "id long, language string, script string")
    fixed = lambda *ls: [r["language"] for r in language.correct_by_prior(frame(*ls)).orderBy("id").collect()]
    assert fixed("English", "English", "Unknown", "Latin (Unknown)") == ["English"] * 4
    assert fixed("CJK", "CJK", "CJK", "Unknown") == ["CJK", "CJK", "CJK", "Unknown"]
    assert fixed("English", "English", "English", "Mixed Script")[-1] == "Mixed Script"
    assert fixed("Unknown", "Unknown") == ["Unknown"] * 2


def test_encodings(spark):
    german = "Größe und Maß für alle Straßen, schöne Grüße aus München und Köln an die Universität. " * 4
    frame = spark.createDataFrame([(0, b"plain"), (1, "Größe".encode()), (2, german.encode("latin-1"))], "id long, content binary")
    got = {r["id"]: r for r in encoding.decode(frame).collect()}
    assert got[0]["encoding"] == got[1]["encoding"] == "utf-8" and got[1]["text"] == "Größe"
    assert got[2]["encoding"] != "utf-8" and "Straßen" in got[2]["text"]
    assert [encoding.canonical(x) for x in ("ascii", "latin1", "cp1252", "UTF8", None, "nope")] == ["utf-8", "iso-8859-1", "windows-1252", "utf-8", "unknown", "nope"]


def test_mojibake(spark):
    bad = "Le résumé est prêt à être envoyé".encode().decode("latin-1")
    frame = texts(spark, bad, "Plain ASCII text that is fine", "Une phrase française correcte, été", "short Ã©")
    assert {r["id"]: r["is_damaged"] for r in text_quality.mojibake(frame).collect()} == {0: True, 1: False, 2: False}
    assert frame.select(text_quality.round_trip_repairs(F.col("text"))).first()[0] == "Le résumé est prêt à être envoyé"


def test_readability(spark):
    easy, noise = "The cat sat on the mat. The dog ran to him. " * 8, "aeioq8x7aeiouzyaeio9aeiuaieoaeuiaeo " * 8
    got = {r["id"]: r for r in text_quality.readability(texts(spark, easy, noise, "too short")).collect()}
    assert got[0]["flesch"] > 30 and not got[0]["is_low_quality"] and got[1]["is_low_quality"] and 2 not in got


def python_simhash(text, bits=64):
    import hashlib
    import re

    w = re.findall(r"[^\W]+", text.lower())
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else w
    if not shingles:
        return 1
    hs = [int(hashlib.md5(s.encode()).hexdigest()[: bits // 4], 16) for s in shingles]
    return sum(1 << k for k in range(bits) if sum(1 if h >> k & 1 else -1 for h in hs) > 0)


def test_simhash(spark):
    base = [f"word{k % 50} of the report number {k}" for k in range(40)]
    values = [" ".join(base), " ".join([*base[:20], "changed", *base[20:]]), " ".join(f"other{k} thing{k}" for k in range(60)), "!" * 60, "one two" + "!" * 60]
    got = {r["id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(texts(spark, *values)).collect()}
    assert got == {k: python_simhash(v) for k, v in enumerate(values)}
    assert (got[0] ^ got[1]).bit_count() < 20


def test_bands_find_all_pairs(spark):
    rng = random.Random(11)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 8))) for f in fps for _ in range(4)]
    frame = spark.createDataFrame([(k, f - 2**64 if f >= 2**63 else f) for k, f in enumerate(fps)], "id long, fp long")
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 5:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(fps))}
    sizes = {r: list(want.values()).count(r) for r in want.values()}
    got = {r["id"]: r["cluster_id"] for r in simhash.clusters(simhash.pairs(frame)).collect()}
    assert got == {i: r for i, r in want.items() if sizes[r] > 1}


def test_wide_and_long_fingerprints(spark):
    rng = random.Random(5)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(12)]
    rows = base + [tuple(f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 12))) for f in fp) for fp in base for _ in range(5)]
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    frame = spark.createDataFrame([(k, signed(a), signed(b)) for k, (a, b) in enumerate(rows)], "id long, fp long, fp_lo long")
    dist = lambda i, j, parts: sum((rows[i][p] ^ rows[j][p]).bit_count() for p in parts)
    for cols, parts, t in ((["id", "fp"], (0,), 17), (["id", "fp", "fp_lo"], (0, 1), 10), (["id", "fp", "fp_lo"], (0, 1), 40)):
        firsts = {}
        for k, r in enumerate(rows):
            firsts.setdefault(tuple(r[p] for p in parts), k)
        reps = sorted(firsts.values())
        want = {(i, j, dist(i, j, parts)) for i in reps for j in reps if i < j and dist(i, j, parts) <= t} | {(firsts[tuple(r[p] for p in parts)], k, 0) for k, r in enumerate(rows) if firsts[tuple(r[p] for p in parts)] != k}
        assert {tuple(r) for r in simhash.pairs(frame.select(*cols), t).collect()} == want


@pytest.mark.parametrize("n_parts, threshold", [(1, 17), (1, 20), (2, 36), (2, 40)])
def test_wide_pairs_by_pieces_are_all_pairs(monkeypatch, n_parts, threshold):
    """Each pair once, as without pieces; far fewer than all are compared at 17 of 64 bits."""
    import numpy as np

    rng = np.random.default_rng(4)
    left = [rng.integers(0, 2**63, 400).astype(np.uint64) for _ in range(n_parts)]
    right = [np.concatenate([x, x ^ rng.integers(0, 2**63, 400).astype(np.uint64) & rng.integers(0, 2**63, 400).astype(np.uint64)]) for x in left]
    every = sum(np.bitwise_count(x[:, None] ^ y[None, :]).astype(int) for x, y in zip(left, right, strict=True))
    want = sorted((i, j, every[i, j]) for i, j in zip(*np.nonzero(every <= threshold), strict=True))
    compared, tiles = [], simhash._tiles
    monkeypatch.setattr(simhash, "_tiles", lambda x, y, t: (compared.append(len(x[0]) * len(y[0])), tiles(x, y, t))[1])
    assert sorted(tuple(map(int, z)) for found in simhash._near(left, right, threshold) for z in zip(*found, strict=True)) == want
    assert threshold != 17 or sum(compared) < 0.4 * every.size


def test_language_model_fills_gaps(spark):
    frame = texts(spark, SENTENCES["Latin (Unknown)"], SENTENCES["Thai"], SENTENCES["English"], "short")
    got = {r["id"]: r["language"] for r in language.refine(language.detect(frame), frame, lambda t: "Klingon" if t.isascii() else None).collect()}
    assert got == {0: "Klingon", 1: "Thai", 2: "English", 3: "Unknown"}


def test_cluster_similarity_is_the_mean_over_all_pairs(spark):
    prints = spark.createDataFrame([(0, 0b1111), (1, 0b1110), (2, 0b0110)], "id long, fp long")
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "id long, cluster_id long")
    r = simhash.cluster_similarity(members, prints).first()
    assert (r["n_members"], r["similarity"]) == (3, round(1 - (1 + 2 + 1) / 3 / 64, 4))


def test_minhash(spark):
    base = [f"w{k}" for k in range(120)]
    frame = texts(spark, " ".join(base), " ".join([*base[:60], "x", *base[61:]]), " ".join(f"v{k}" for k in range(120)), " ".join(base))
    pairs = {(r["a"], r["b"]): r["estimate"] for r in minhash.candidate_pairs(minhash.signatures(frame)).collect()}
    assert set(pairs) == {(0, 1), (0, 3)} and pairs[0, 3] == 1.0
    exact = {(r["a"], r["b"]): r["jaccard"] for r in minhash.jaccard(frame, spark.createDataFrame([(0, 1)], "a long, b long")).collect()}
    assert exact[0, 1] == pytest.approx(115 / 121) and abs(pairs[0, 1] - exact[0, 1]) < 0.12
    assert minhash.band_shape() == (14, 9) and minhash.band_shape(128, 0.5) == (25, 5)


def test_shingles_are_counted_in_their_row(spark):
    """Nothing is shuffled by shingle; texts that share an id, or have none, are counted together."""
    a, b = "a b c d " * 20, "b c d é " * 20
    rows = spark.createDataFrame([(1, a), (2, b), (2, a), (None, a), (None, a), (3, "-" * 60), (4, "x" * 60)], "id long, text string")
    want = {tuple(r) for r in simhash.shingles(rows).groupBy("id").agg(F.count("*"), F.count_distinct("shingle"), F.min("shingle")).collect()}
    assert {tuple(r) for r in simhash.shingle_counts(rows).collect()} == want and len(want) == 4
    plan = simhash.shingle_counts(rows.where("id = 1"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_jaccard_sets_are_made_in_their_row(spark):
    frame = texts(spark, "a b c d e " * 20, "a b c d x " * 20, "- " * 60)
    found = minhash.jaccard(frame, spark.createDataFrame([(0, 1)], "a long, b long"))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0] and "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first()["jaccard"] == pytest.approx(2 / 8)


def test_digests_are_made_a_text_at_a_time(spark):
    """Batches to Python hold words; of 0 to 4 words each shingle is there once, as in the shingles themselves."""
    import hashlib

    import pyarrow as pa

    for n in range(6):
        w = [f"é{k}" for k in range(n)]
        want = [" ".join(w[k : k + 3]) for k in range(n - 2)] if n > 2 else w
        assert [bytes(r) for r in simhash.digests(pa.scalar(" ".join(w)))] == [hashlib.md5(x.encode()).digest() for x in want]
    assert "md5" not in simhash.fingerprints(texts(spark, "a b c d " * 20))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bits", [64, 128])
def test_fingerprints_are_made_once_for_pairs(spark, bits):
    frame = texts(spark, *["a b c d " * 20] * 2, "x y z " * 20)
    found = simhash.pairs(simhash.fingerprints(frame, bits), simhash.scaled_threshold(5, bits))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(0, 1, 0)]


def test_rows_by_key_are_not_broadcast(spark):
    """A table in memory has a known small size, and rows by key are several times as many."""
    prints = spark.range(2000).selectExpr("id", "xxhash64(id) AS fp").persist()
    frame = texts(spark, *(" ".join(f"w{k}" for k in range(j, 60 + j)) for j in range(3)))
    sigs = minhash.signatures(frame).persist()
    for cached, made in ((prints, simhash.pairs), (sigs, minhash.candidate_pairs)):
        cached.count()
        lines = made(cached)._jdf.queryExecution().executedPlan().toString().splitlines()
        joins = [line for line in lines if "Join" in line and "key#" in line]
        assert joins and all("Broadcast" not in line for line in joins)
        cached.unpersist()


def test_signatures_extract_words_once(spark):
    """Also of long texts: words are not extracted again for each shingle, and texts without words have no signature."""
    frame = texts(spark, "a b c d " * 20, "-" * 60)
    sigs = minhash.signatures(frame)
    assert sigs._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r["id"] for r in sigs.collect()] == [0]


def test_minhash_buckets_hold_no_signatures(spark):
    """What is shuffled by bucket are ids: the expanded rows have no array."""
    frame = texts(spark, *(" ".join(f"w{k}" for k in range(j, 60 + j)) for j in range(3)))
    plan = minhash.candidate_pairs(minhash.signatures(frame))._jdf.queryExecution().optimizedPlan().toString()
    lists = [line for line in plan.splitlines() if "Generate explode" in line]
    assert lists and all("sig#" not in line.rpartition("[")[0].rpartition("[")[2] for line in lists)
    assert not any("sig#" in line for line in plan.splitlines() if "Project [rep#" in line and "key#" in line)


@pytest.mark.parametrize("shape", [(7, 2), (9, 4)])
def test_longer_keys_find_the_same_pairs(spark, monkeypatch, shape):
    assert simhash.key_shape(1000, 5) == (6, 1) and simhash.key_shape(10**9, 5)[0] > 8
    rng = random.Random(2)
    fps = [rng.getrandbits(63) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(1, 8))) for f in fps for _ in range(5)]
    want = {(i, j, (fps[i] ^ fps[j]).bit_count()) for i in range(len(fps)) for j in range(i + 1, len(fps)) if 0 < (fps[i] ^ fps[j]).bit_count() <= 5}
    monkeypatch.setattr(simhash, "key_shape", lambda *_: shape)
    got = simhash.pairs(spark.createDataFrame(list(enumerate(fps)), "id long, fp long")).where("distance > 0").collect()
    assert {(r["a"], r["b"], r["distance"]) for r in got} == want


def test_semantic(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    rows = np.concatenate([base, base + 0.15 * rng.standard_normal((30, 16)), np.zeros((1, 16))])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    u = rows[:60] / np.linalg.norm(rows[:60], axis=1, keepdims=True)
    cos = u @ u.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if cos[i, j] >= 0.85}
    for block in (20_000, 17):
        assert {(r["a"], r["b"]) for r in semantic.similar_pairs(frame, block_rows=block).collect()} == want
    chain = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9)], "a long, b long, cosine double")
    assert {(r["cluster_id"], r["id"]) for r in semantic.greedy_clusters(chain).collect()} == {(1, 1), (1, 2), (3, 3), (3, 4)}


def test_semantic_clusters_without_all_pairs(spark, monkeypatch):
    """Components and greedy clusters are those of all pairs, for dense and sparse links, however rows are cut."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(3 * k + 7, v.tolist()) for k, v in enumerate(rng.standard_normal((240, 8)))]
    frame = spark.createDataFrame([*rows, (5000, [0.0] * 8)], "vec_id long, embedding array<double>").repartition(3)
    set_of = lambda f: {(r["cluster_id"], r["id"]) for r in f.collect()}
    monkeypatch.setattr(semantic, "TILE", (16, 32))
    monkeypatch.setattr(semantic, "BATCH", 50)
    for threshold in (0.4, 0.8):
        pairs = semantic.similar_pairs(frame, threshold).cache()
        by_pairs, linked = set_of(semantic.greedy_clusters(pairs)), set_of(simhash.clusters(pairs))
        for prefix, block in ((20, 60), (1000, 20_000)):
            assert set_of(semantic.clusters(frame, threshold, block_rows=block, prefix=prefix)) == by_pairs
            assert set_of(semantic.components(frame, threshold, block_rows=block)) == linked
        forest = semantic.similar_pairs(frame, threshold, links_only=True).count()
        assert forest < 240 and (threshold > 0.5 or forest < pairs.count() / 10)
    none = frame.where("vec_id < 0")
    assert semantic.clusters(none).isEmpty() and semantic.components(none).isEmpty()


def test_scripts_are_counted_beyond_ascii(spark):
    """Ten scripts do not read an ASCII text ten times: the part beyond it is cut out once, and counts are as they were."""
    import re

    rows = texts(spark, "plain words", "Straße и слово 漢字かな", "עברית ไทย ελ", "\x7f\x80é")
    counts = language.script_histogram(rows)
    for r in counts.join(rows, "id").collect():
        assert all(r["n_" + n.lower().replace(" ", "_")] == len(re.findall("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in language.SCRIPTS[n]) + "]", r["text"])) for n in language.SCRIPTS)
    for frame in (counts, language.detect(rows)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("x7F") == 1


def test_table_adapter(spark, sf_dir):
    frame = C.from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang", "source")
    assert frame.columns == ["id", "size", "mime", "cluster", "text"] and frame.count() == 200


def test_pii_queries_with_all_patterns(spark, sf_dir, tmp_path):
    """Documents whose only personal data is one of the types with look-around, against Python's re."""
    import re

    from gleanery.plans import registry

    planted = ["call 555-123-4567 or (555) 123-4567 now, but not #555-123-4567", "ssn 456-78-1234 and 078-05-1120 and 000-12-3456", "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", "nothing here"]
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(-1 - k, t, "en", "s", len(t)) for k, t in enumerate(planted)], frame.schema)
    frame.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    q = registry.queries()
    run = lambda name: q[name](spark, str(tmp_path)).collect()
    rows = {r["doc_id"]: r["text"] for r in frame.unionByName(more).collect()}
    counts = {(r["id"], r["pattern"]): r["n"] for r in run("pii_counts")}
    for name in ("phone", "ssn", "ipv6_address", "email", "ip_address"):
        found = {d: [m for line in (t or "").split("\n") for m in re.findall(pii.BY_NAME[name].regex, line)] for d, t in rows.items()}
        want = {d: sum(name != "ssn" or m.replace("-", "") not in pii.TEST_SSNS for m in f) for d, f in found.items()}
        assert {d: n for (d, p), n in counts.items() if p == name} == {d: n for d, n in want.items() if n}
    assert [counts.get((-1 - k, p)) for k, p in enumerate(("phone", "ssn", "ipv6_address"))] == [2, 1, 1]
    assert {"phone", "ssn", "ipv6_address"} <= {r["pattern"] for r in run("pii_matches_by_type")}
    some = {d for d, _ in counts}
    assert {r["id"] for r in run("pii_file_rollup")} == some
    for name in ("file_report", "csv_report"):
        assert {r["id"] for r in run(name) if r["has_pii"]} == some
    assert {r["id"] for r in run("sarif_findings") if r["rule_id"] == "FC005"} == some
    assert all(r["n_failures"] > 0 for r in run("junit_cases") if r["id"] in some)
    assert next(r["rate"] for r in run("gate") if r["metric"] == "pii") == round(len(some) / len(rows), 6)
    assert sum(r["n_pii"] for r in run("corpus_summary")) == len(some)


def test_own_patterns_may_have_any_name(spark):
    """What a built-in pattern of the same name needs, and its check, is not asked of them."""
    rows = spark.createDataFrame([(1, "code 12345 and 99999")], "id long, text string")
    for name in ("email", "credit_card", "mine"):
        own = [pii.Pattern(name, name, r"\b\d{5}\b")]
        assert [tuple(r) for r in pii.count_matches(rows, own).collect()] == [(1, name, 2)]
        assert pii.matches(rows, own).count() == 2


def test_long_texts_are_read_to_their_end(spark):
    damaged = "word " * 20_000 + "Ã©"
    plain = "This is a short and easy text. " * 500 + "Incomprehensibility notwithstanding, characteristically multitudinous considerations" * 200
    late = "zzz qqq " * 2_000 + "the and of to in is that " * 3
    rows = spark.createDataFrame([(1, damaged), (2, plain), (3, late)], "id long, text string")
    assert {r["id"] for r in text_quality.mojibake(rows).where("is_damaged").collect()} == {1}
    assert text_quality.mojibake(rows, max_chars=50_000).where("is_damaged").count() == 0
    score = lambda n: text_quality.readability(rows, n).where("id = 2").first()["flesch"]
    assert score(None) < score(10_000)
    assert language.detect(rows).where("id = 3").first()["language"] == "English"
    assert language.detect(rows, max_chars=5_000).where("id = 3").first()["language"] == language.LATIN_UNKNOWN


def test_byte_cuts_keep_characters_whole(spark):
    raw = "aé漢\U0001f469".encode() * 3
    for n in range(1, len(raw) + 1):
        kept = encoding.head_bytes(raw, n)
        assert len(raw) < n or (n - 4 < len(kept) <= n and kept.decode() is not None)
    files = spark.createDataFrame([(raw,)], "content binary")
    for n in (1, 2, 3, 5, 9, 10, len(raw), None):
        got = encoding.decode(files, max_bytes=n).first()
        assert (got["text"], got["encoding"]) == (encoding.head_bytes(raw, n).decode(), "utf-8")
