"""The ten operators against brute force, round trips and defined cases on small tables."""

import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common, decontaminate, fingerprints, jaccard, mixing, pii, quality, toxicity, urls, warc
from weftgraph.llm.components import components

WORDS = "ba de fi go hu ka le mi no pu ra se ti vo wa xe yo zu an el".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, a null, an empty and a blank text, a long text, a repeated row, a null id and source, an extra column of a clashing name."""
    rng = random.Random(3)
    base = [text(rng, 60) for _ in range(12)]
    rows = [(i, t, "s%d" % (i % 3), 1.0) for i, t in enumerate(base)]
    edited = base[0].split()
    edited[20] = "changed"
    rows += [(20, base[0], "s1", 1.0), (21, " ".join(edited), "s0", 1.0), (22, None, "s0", None), (23, "", None, 1.0), (24, " \n\t", "s2", 1.0), (25, text(rng, 4000), "s0", 1.0), (3, base[3], "s0", 1.0), (None, base[5], "s1", 1.0), (26, "one two", "s2", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double")


def sizes(docs):
    return [len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in docs.collect()]


def test_span_hashes_agree_wherever_a_word_stands():
    batch = pa.record_batch([pa.array(["The cat", None, "a the  cat\n", ""])], ["text"])
    (_, data, offsets), *_ = common.slices(batch)
    hashes, starts, ends, counts = common.words(data, offsets)
    assert counts.tolist() == [2, 0, 3, 0] and hashes[0] == hashes[3] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 3


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 1), (7, 8), (2, 2)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(links).collect()} == {(x, 1) for x in (1, 3, 4, 5, 9)} | {(7, 7), (8, 7)}


def test_jaccard_join_against_brute_force(spark, docs):
    got = jaccard.near_duplicates(docs, 4, 85)
    rows = [(r["doc_id"], (r["text"] or "").lower().split()) for r in docs.collect()]
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []) for _, w in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[b]:
                group = [group[b] if g == group[a] else g for g in group]
    want = sorted((str(i), len(s), min((rows[k][0] for k in range(len(rows)) if group[k] == group[n] and rows[k][0] is not None), default=None)) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    assert jaccard.near_duplicates(docs.limit(0), 4, 85).count() == 0


def test_mixing_takes_near_the_targets(spark, docs):
    rng = random.Random(5)
    many = spark.createDataFrame([(i, text(rng, rng.randint(1, 60)), "abc"[min(i % 7, 2)]) for i in range(700)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(many).collect()
    assert len(rows) == 700 and all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in rows)
    total = sum(r["size"] for r in rows)
    for s in "abc":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 0.02 * total
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(many.repartition(5)).collect()))
    got = mixing.mix_sources(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(sizes(docs))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 100, 400).astype(float), np.full(400, 0.3)
    out = mixing.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-4


def test_warc_round_trip_over_any_splits(spark, tmp_path):
    rows = [(5, "http://a/1", "x" * 9000), (2, "http://a/2", "same"), (9, None, "same"), (1, "http://a/3", None), (4, "u\r\nv", ""), (2, "http://a/2", "same"), (None, "http://n", "same"), (7, "http://z", "é中")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    for split in (37, 300, 1 << 20):
        got = warc.read_archives(spark, archives, split).collect()
        assert len(got) == len(rows)
        assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((str(i), len((h or "").encode()), warc.digest((h or "").encode())) for i, _, h in rows)
        kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
        assert kinds == sorted([("5", "response", None), ("2", "response", None), ("2", "revisit", 2), ("9", "revisit", 2), ("None", "revisit", 2), ("1", "response", None), ("4", "revisit", 1), ("7", "response", None)])
        assert all(bytes(r["payload"]).decode() == "é中" for r in got if r["page_id"] == 7)


def test_false_magic_is_no_member(tmp_path):
    junk = warc.MAGIC + b"\x00" * 20 + gzip.compress(b"no record") + warc.MAGIC
    member = warc.record(3, "http://a", b"hello", None, False)
    path = tmp_path / "f.warc.gz"
    path.write_bytes(junk + member + junk + member)
    with pa.OSFile(str(path)) as source:
        found = [o for o, _ in warc._members(source, 0, path.stat().st_size)]
    assert found == [len(junk), 2 * len(junk) + len(member)]


def test_fingerprints(spark, docs):
    rng = random.Random(9)
    base = text(rng, 300)
    edits = list(base)
    for _ in range(12):
        k = rng.randrange(len(edits))
        edits[k : k + 1] = rng.choice(["", "q", "zz"])
    a, b, c = fingerprints.embed([fingerprints.points(t) for t in (base, "".join(edits), text(rng, 300))])
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > fingerprints.likeness(a, c) + 0.2
    assert set(fingerprints.band_keys(a)) & set(fingerprints.band_keys(b)) and not set(fingerprints.band_keys(a)) & set(fingerprints.band_keys(c))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()), reverse=True)
    one = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for parts in (1, 7):
        got = {r["doc_id"]: r for r in fingerprints.compare_neighbours(one, parts).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(rows):
            edited = fingerprints.edited_text(t, rows[(k + 1) % len(rows)][1])
            assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert fingerprints.compare_neighbours(docs).count() == docs.count() and fingerprints.compare_neighbours(docs.limit(0), 3).count() == 0


def test_alignment_against_plain_smith_waterman():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 5, 12), rng.integers(0, 5, 25)
        h = np.zeros((13, 26))
        for i in range(12):
            for j in range(25):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
        assert abs(decontaminate.align(a.astype(np.uint64), b.astype(np.uint64)) - h.max()) < 1e-9


def test_decontamination_finds_edited_copies(spark, docs):
    rng = random.Random(11)
    item = text(rng, 40)
    edited = item.split()
    for k in (5, 12, 19, 26, 33):
        edited[k] = "other"
    rows = [(100, f"{text(rng, 30)} {item.upper()} {text(rng, 30)}"), (101, f"{text(rng, 50)} {' '.join(edited)}"), (102, text(rng, 200))]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.benchmark_matches(some, bench).collect()} == {(100, 1), (101, 1)}
    assert decontaminate.clean(some, bench).count() == some.count() - 2
    assert decontaminate.benchmark_matches(some, bench.limit(0)).count() == 0


def test_decontamination_loses_no_alignment(spark):
    rng = random.Random(5)
    items = [text(rng, n) for n in (40, 20, 24, 30, 7, 4, 3, 12)]
    rows = []
    for item in items:
        for every in (2, 3, 4, 5, 6, 7):
            for edit in ("replace", "insert", "drop"):
                w = [x for k, x in enumerate(item.split()) for x in ([x] if (k + 1) % every else {"replace": ["other"], "insert": [x, "other"], "drop": []}[edit])]
                rows.append((len(rows), f"{text(rng, 30)} {' '.join(w)} {text(rng, 30)}"))
    rows += [(len(rows) + k, items[0]) for k in range(20)]  # copies make the kept words commoner than the edited ones
    hashed = lambda t: common.words(*common.utf8(pa.array([t])), between=common.SIGNS)[0]
    want = {}
    for d, t in rows:
        for i, item in enumerate(items):
            if (score := decontaminate.align(hashed(item), hashed(t)) / len(item.split())) >= decontaminate.THRESHOLD:
                want[d, i] = score
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == want and {d for d, i in want if i == 0} >= {3, 6, 9, 12, 15}


def test_surrogates(spark):
    rows = [(1, "Mail Bob.Lee7@corp.example.org or bob.lee7@corp.example.org", 0), (2, "call +1 (555) 010-2030, card 4111 1111 1111 1111 and 4111111111111111", 0), (3, "Frau Anna Weber met Herr Weber", 0), (4, "from 10.1.2.3 with password=hunter22x", 0), (5, None, 0), (6, "version 1.2 of 2024, plain", 26)]
    got = {r["doc_id"]: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    mail = re.findall(r"\S+@\S+", got[1]["text"])
    assert mail[0].lower() == mail[1].lower() != "bob.lee7@corp.example.org" and mail[0][0].isupper() and mail[0].endswith(".org")
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[2]["text"])
    assert cards[0].replace(" ", "") == cards[1] and pii.luhn(cards[1]) and "4111" not in cards[1][1:5]
    names = re.fullmatch(r"Frau (\w+) (\w+) met Herr (\w+)", got[3]["text"]).groups()
    assert names[1] == names[2] != "Weber" and names[0] != "Anna"
    assert "hunter22x" not in got[4]["text"] and "10.1.2.3" not in got[4]["text"]
    assert got[5]["text"] is None and got[6]["text"] == rows[5][1] and got[6]["n_entities"] == 0
    many = spark.createDataFrame([("family", f"name{k}") for k in range(300)] + [("ssn", f"{k:09d}") for k in range(300)], "kind string, value string")
    table = pii.surrogate_table(many).collect()
    assert len(table) == 600 == len({(r["kind"], r["surrogate"]) for r in table}) and not {r["surrogate"] for r in table} & {r["value"] for r in table}


def test_surrogates_whatever_the_characters(spark):
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    rows = [(1, "password=**** and passwd=密码密码"), (2, "1: card " + "4111111111111111".translate(arabic)), (3, "4111 1111 1111 1111 and " + "5500000000000".translate(arabic)), (4, "call " + "+49 30 1234567".translate(arabic) + " now"), (5, "api_key=½½½½")]
    got = {r["doc_id"]: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["n_entities"] for k in range(1, 6)] == [2, 1, 2, 1, 1]
    assert not re.search(r"=\*{4}|密码密码", got[1]["text"]) and "½" not in got[5]["text"]
    a, b = re.search(r"card ([٠-٩]{16})$", got[2]["text"])[1], re.match(r"(\d{4} ){3}\d{4}", got[3]["text"])[0]
    assert pii.ascii_digits(a) == b.replace(" ", "") != "4111111111111111" and got[4]["text"] != rows[3][1]


def test_surrogates_get_longer_when_a_format_is_used_up(spark):
    every = spark.createDataFrame([("password", f"{k:04d}") for k in range(10000)] + [("card", "4111111111111111")], "kind string, value string")
    table = pii.surrogate_table(every, most=2).collect()
    assert len({r["surrogate"] for r in table}) == 10001 and not {r["surrogate"] for r in table} & {r["value"] for r in table}
    for kind, value in [("ip", "1.2.3.4"), ("family", "weber"), ("email", "a@b.org"), ("access", "AKIA" + "B" * 16), ("secret", "a1" * 16), ("iban", "DE89370400440532013000"), ("card", "4111111111111111"), ("phone", "4930123456"), ("ssn", "123456789")]:
        new = pii.surrogate(kind, value, 50, longer=3)
        assert len(new) > len(pii.surrogate(kind, value, 50)) and (kind != "card" or pii.luhn(new)) and len(pii.formatted(kind, value, new)) == len(new)


def test_surrogates_of_names_without_a_title(spark):
    rows = [(1, "Frau Anna Weber came. Later Weber's car and WEBER, then Anna-Maria; a weber, Webers"), (2, "Weber alone"), (3, "Then Weber wrote to x.weber@Weber.example.org. Herr Weber left")]
    got = {r["doc_id"]: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    given, family, again, upper, anna = re.fullmatch(r"Frau (\w+) (\w+) came. Later (\w+)'s car and (\w+), then (\w+)-Maria; a weber, Webers", got[1]["text"]).groups()
    assert again == family == upper.title() and upper.isupper() and anna == given and got[1]["n_entities"] == 5
    assert got[2]["text"] == rows[1][1] and "Weber" not in got[3]["text"] and got[3]["text"].startswith(f"Then {family} wrote") and got[3]["n_entities"] == 3


def test_toxicity_holds_for_gapped_insults():
    rng = random.Random(2)
    clean = [". ".join(text(rng, 12) for _ in range(4)) for _ in range(150)]
    toxic = []
    for _ in range(60):
        w = text(rng, 40).split()
        w[rng.randrange(40)] = rng.choice(["blorkhead", "snigglefoot"])
        toxic.append(" ".join(w))
    machine = toxicity.train(clean + toxic, [0] * 150 + [1] * 60)
    scores = machine.words([b"blorkhead", b"b.l.o.r.k.h.e.a.d", b"blorkxhead", b"bade", b"lemi"])
    assert (scores[:3] > 0).all() and (scores[3:] < 0).all()
    assert toxicity.joined_letters([b"i", b"d", b"x", b"ab", b"c"]) == [b"idx"]


def test_toxicity_defined_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, none).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.0}


def test_ordinal_thresholds_stay_ordered():
    rng = random.Random(8)
    texts = [text(rng, 30) for _ in range(80)] + [text(rng, 20) + " ### ###" * 5 for _ in range(80)] + ["### %%% " * 20 for _ in range(80)]
    model = quality.fit(quality.dense(texts), np.repeat([2, 1, 0], 80))
    score = quality.dense(texts) @ model.weights
    expected = model.expected(score)
    assert (np.diff(model.thresholds) > 0).all() and expected[:80].mean() > 1.5 > expected[80:160].mean() > 0.5 > expected[160:].mean()
    assert quality.Ordinal([1], np.zeros(3), np.zeros(0)).expected(np.zeros(2)).tolist() == [1.0, 1.0]


def test_url_rules_and_segments(spark):
    rows = [(1, "http://A.Example.ORG/en/12?x"), (2, "https://example.com/fr/a"), (3, "x"), (4, None), (5, "http://cheappillsonline.net/buy"), (6, "http://dailynews.net/a"), (7, "http://notexample.org"), (8, "http://example.org/es/#a")]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (1, 2, 3, 4, 7, 8)] == [("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.com", "/fr/a", "com/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notexample.org", "", None, "allow"), ("example.org", "/es/", "example.org/es/", "block")]
    assert got[5]["words"].startswith("cheap pills online") and got[5]["verdict"] == "block" and got[6]["words"].startswith("daily news") and got[6]["verdict"] == "allow"


def test_url_parts_of_any_script(spark):
    rows = [(1, "http://bet365.net/a"), (2, "http://новости-дня.net/7/страница"), (1, "http://bet365.net/a"), (None, "http://x.net/12345")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    words = {(r["page_id"], r["verdict"], r["words"]) for r in got}
    assert len(got) == 4 and (1, "block", "bet365 a") in words and {w for i, _, w in words if i == 2} == {"новости дня страница"}
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_split(text, counts):
    """All splits of all prefixes, every part of the names at hand."""
    total = sum(counts.values()) + 1
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        best.append(min((best[k][0] + min(-np.log(counts[text[k:end]] / total) if text[k:end] in counts else np.inf, 10 + 4.0 * (end - k)), k) for k in range(end)))
    out, end = [], len(text)
    while end:
        out.insert(0, text[best[end][1] : end])
        end = best[end][1]
    return out


def test_url_names_beyond_those_held(spark):
    """Rare, long and many parts of names are words like the others, whether a task holds them or not."""
    long, longer = "donaudampfschifffahrtsgesellschaftskapitaen", "ab" * 40
    hosts = [f"{a}{b}-{c}{d}" for a in WORDS for b in WORDS for c, d in zip(WORDS, WORDS[3:], strict=False)][:300] + ["zzglorp-zzfrub", f"die-{long}", f"{longer}-shop", "новости-дня"]
    hosts += ["zzglorpzzfrub", f"zzfrubcasino{long}bets", f"casino{'qx' * 30}zzglorp", f"{longer}zzfrub", "новостиzzfrubдня", "bafigohuzzglorpkale", "hotnews"]
    pages = spark.createDataFrame([(n % 50, f"http://{h}.net/{h[::-1]}/{h}") for n, h in enumerate(hosts)] + [(None, "http://zzglorpzzfrub.net"), (1, None)], "page_id long, url string")
    counts = {r["w"]: r["n"] for r in urls.part_counts(pages.select(urls.host_and_path(F.col("url"))[0].alias("host"))).collect()}
    model = urls.UrlModel(counts)
    every = {w: counts.get(w, 0) + model.listed[w] for w in counts.keys() | model.listed.keys()}
    got = {held: sorted((str(r["page_id"]), r["host"], r["path"], r["verdict"], r["words"], r["odds"]) for r in urls.filter_urls(pages, held=held).collect()) for held in (urls.HELD_PARTS, 7, 0)}
    assert got[0] == got[7] == got[urls.HELD_PARTS] and len(got[0]) == len(hosts) + 2
    for _, host, path, _, words, _ in got[0]:
        assert words.split() == [w for p in urls.parts(host, path) for w in plain_split(p, every)]
    words = {host: words.split() for _, host, _, _, words, _ in got[0]}
    assert words["zzglorpzzfrub.net"][:2] == ["zzglorp", "zzfrub"] and words[f"zzfrubcasino{long}bets.net"][:4] == ["zzfrub", "casino", long, "bets"]
    assert words[f"{longer}zzfrub.net"][:2] == [longer, "zzfrub"] and words[f"casino{'qx' * 30}zzglorp.net"][:3] == ["casino", "qx" * 30, "zzglorp"]


def test_url_more_names_than_held(spark):
    """A part seen once is a word even where more parts than a task holds are seen twice."""
    letters = F.translate(F.col("id").cast("string"), "0123456789", "bcdfghjklm")
    common = spark.range(21_000).select(F.concat(F.lit("http://x-w"), letters, F.lit(".w"), letters, F.lit("-x.net")).alias("url"))
    rare = spark.createDataFrame([("http://zzglorp-zzfrub.net",), ("http://zzglorpzzfrub.net",)], "url string")
    got = urls.filter_urls(common.union(rare).select(F.lit(1).alias("page_id"), "url"))
    assert [r["words"] for r in got.filter(F.col("host").startswith("zz")).collect()] == ["zzglorp zzfrub"] * 2


def test_quality_defined_cases(spark, docs):
    ratings = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (22, 0), (None, 2), (4, None)], "doc_id long, grade int")
    got = quality.score_quality(docs, ratings).collect()
    assert len(got) == docs.count() and all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    assert len({round(r["tail"], 9) for r in got if r["doc_id"] == 3}) == 1 and quality.score_quality(docs.limit(0), ratings).count() == 0
    assert {r["expected_grade"] for r in quality.score_quality(docs, ratings.limit(0)).collect()} == {0.0}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Toxic, copied, near, benchmark and personal rows, each on its own; sets and alignments by plain Python."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    base = [text(rng, 50) for _ in range(60)]
    bad = [f"{text(rng, 20)} blorkhead {text(rng, 20)}" for _ in range(30)]
    item = text(rng, 30)
    near = base[1].split()
    near[49] = "changed"
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t) for k, t in enumerate(bad)]
    rows += [(200, base[0]), (201, " ".join(near)), (3, base[3]), (5, base[1]), (210, f"{text(rng, 40)} {item}"), (211, f"{text(rng, 40)} reach x.y@z.example.com"), (220, None), (221, "")]
    table = spark.createDataFrame([(i, t, "en", "s%d" % (i % 3), len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, t in rows if i < 130 and i % 4], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, seen = str(tmp_path), {}
    out = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = common.kept(stage(spark, out, d))
        seen[name] = out.collect()
    pairs = lambda name: sorted((r["doc_id"], r["text"] or "") for r in seen[name])
    want = sorted((i, t or "") for i, t in rows if "blorkhead" not in (t or ""))
    assert pairs("toxicity") == want
    shingles = [frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for _, t in want]
    left = []
    for (i, t), s in zip(want, shingles, strict=True):
        if not s or all(100 * len(s & u) < 80 * len(s | u) for _, u in left):
            left.append(((i, t), s))
    want = [row for row, _ in left]
    assert pairs("near duplicates") == want and (5, base[5]) in want and (5, base[1]) not in want
    want = [row for row in want if item not in row[1]]
    assert pairs("benchmark decontamination") == want
    assert [i for i, _ in pairs("personal data")] == [i for i, _ in want]
    assert [t for i, t in pairs("personal data") if i != 211] == [t for i, t in want if i != 211] and "x.y@z" not in dict(pairs("personal data"))[211]
    taken = {(r["source"], r["target"]): 0 for r in seen["mixing"]}
    for r in seen["mixing"]:
        taken[r["source"], r["target"]] += r["taken"]
    total = sum(len(t.split()) for _, t in want)
    assert len(taken) == 3 and abs(sum(taken.values()) - total) < 0.1 * total and {r["doc_id"] for r in seen["mixing"]} <= {i for i, _ in want}


def test_one_of_each_decides_by_row(spark, docs):
    rng = random.Random(31)
    a, b = text(rng, 60), text(rng, 60)
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (7, b, "u"), (7, b, "v"), (None, a, "n"), (8, None, "w"), (9, "", "w"), (9, "", "w")]
    table = spark.createDataFrame(rows, "doc_id long, text string, `my col` string")
    got = [tuple(r) for r in jaccard.one_of_each(table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [rows[0], rows[2], rows[6], rows[7], rows[8]]))
    twice = spark.createDataFrame([(1, a, "x"), (1, a, "y"), (2, b, "z")], table.schema)
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.one_of_each(twice).collect()) == [(1, a), (2, b)]
    assert jaccard.one_of_each(table.limit(0)).count() == 0


def test_mixing_passes_ids_on_as_they_are(spark):
    rng = random.Random(12)
    ids = [9007199254740993, 9007199254740995, None, None, 4, 4]
    table = spark.createDataFrame([(i, text(rng, 9), "s") for i in ids], "doc_id long, text string, source string")
    assert sorted(map(str, (r["doc_id"] for r in mixing.mix_sources(table).collect()))) == sorted(map(str, ids))
    alike = spark.createDataFrame([(None, "one two three", "ab"[k % 5 == 0]) for k in range(3000)], table.schema)
    rows = mixing.mix_sources(alike, block_rows=100).collect()
    for s in "ab":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30


def test_mixing_targets_by_plain_resharing(spark):
    sizes = {"a": 100, "b": 10, "c": 40, "d": 0, None: 7}
    rows = [(k, " ".join("w" for _ in range(n)), s) for k, (s, n) in enumerate(sizes.items())]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in order}
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["source"]: (r["source_size"], round(r["target"], 6)) for r in got} == {s: (sizes[s], round(want[s], 6)) for s in order}


def test_toxicity_with_blank_or_odd_tables(spark):
    rng = random.Random(6)
    rows = [(k, f"{text(rng, 9)} blorkhead", "c", 1) for k in range(20)] + [(100 + k, " ", "c", 1) for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, `my col` string, score int")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, *_ in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(table, labels)
    assert got.columns == ["doc_id", "text", "my col", "held_out", "score", "predicted"] and got.count() == 40
    full = spark.createDataFrame([(k, f"{text(rng, 20)}{' blorkhead' if k % 3 == 0 else ''}", "c", 1) for k in range(240)] + [(None, None, "c", 1), (3, "", "c", 1)], table.schema)
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(full, marks).filter("held_out AND doc_id IS NOT NULL AND text <> ''").collect()
    assert scored and all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in scored)
    assert toxicity.score_toxicity(full.limit(0), marks).count() == 0


def test_surrogates_of_a_name_after_several_titles(spark):
    rows = [(1, "Frau Anna Weber and Dr. Anna Weber", 3), (1, "Frau Anna Weber and Dr. Anna Weber", 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, `my col` int")
    got = pii.replace_entities(table.withColumn("n_entities", F.lit("kept")))
    assert got.columns == ["doc_id", "text", "my col", "n_entities", "_n_entities"]
    texts = {r["text"] for r in got.collect()}
    a, b, c, d = re.fullmatch(r"Frau (\w+) (\w+) and Dr\. (\w+) (\w+)", texts.pop()).groups()
    assert not texts and a == c != "Anna" and b == d != "Weber" and a.casefold() in {n.casefold() for n in pii.GIVEN["latin", "f"]}
    assert pii.replace_entities(table.limit(0)).count() == 0
    other = {r["text"] for r in pii.replace_entities(table, b"another key").collect()}
    assert other != {r["text"] for r in got.collect()}
