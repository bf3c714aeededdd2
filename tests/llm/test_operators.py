"""The ten operators against brute force on small tables, with nulls, empty and long texts, ties and repeats."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import additive, components, crc, hmm, htmltext, line_prints, lines, mixing, packing, passages, quality, quality_counts, simhash, storage, store, tokens
from corpusloom.llm import queries as llm_queries
from corpusloom.llm.storage import new_path
from tests.oracle import connect, differences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, fp long, h1 string, rank int"


def corpus(seed=1, n=60):
    """Texts with nulls, empties, copies, near copies, a long one, repeated rows and columns of clashing names."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéx") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() + rng.choice(["", "", ".\n", ","]) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 7):
        texts.append(texts[i])
        texts.append(texts[i].replace(" ", "  ", 1) + " end")
    texts += [None, "", " \n\t", "one", " ".join(word() for _ in range(5000))]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["hot", "hot", "a", "b", None]), 0, 1, 2, "x", 3) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[0], "en", "a", 0, 1, 2, "x", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def classes(n, linked):
    root = [*range(n)]
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (5, 5), (20, 30), (30, 40), (40, 50), (-4, 50), (2, 1)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {2: 1, 3: 1, 9: 8, 20: -4, 30: -4, 40: -4, 50: -4}


def test_joined_components_step_over_joined_classes_only(spark, monkeypatch):
    rng, stepped, steps = random.Random(4), [], components.components
    first = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    then = [(rng.randrange(-5, 310), rng.randrange(-5, 310)) for _ in range(12)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = steps(frame(first), "a", "b")
    monkeypatch.setattr(components, "components", lambda edges, a, b: stepped.append(edges.count()) or steps(edges, a, b))
    got = dict(components.joined_components(known, frame(then), "a", "b").collect())
    assert got == dict(steps(frame(first + then), "a", "b").collect()) and stepped == [12]


def test_driver_gives_freed_memory_back(spark):
    def arenas():
        jvm = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
        return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{jvm}/status").read_text())[1])

    malloc = spark.sparkContext._jvm.java.util.zip.Deflater
    held = [malloc() for _ in range(400)]  # some 250 kB each outside the heap
    for d in held:
        d.end()
    before = arenas()
    assert storage.trimmed(spark) and arenas() < before


def test_tokens_equal_whole_texts():
    e = tokens.encoder(tokens.default_tokenizer())
    odd = ["İstanbul ΑΣ ς é a b　x \x1c y <|endoftext|>z '’s I'LL 12½", "", " \n", "é ́x ŉ ﬁ a b"]
    for t in [*(r[1] for r in corpus() if r[1]), *odd]:
        assert e.encode(t.encode()) == e._whole(t), t


def test_simhash_components(spark, docs, empty):
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs, chunk=4).collect()]
    rows = corpus()
    assert Counter(g[0] for g in got) == Counter(r[0] for r in rows)

    def brute(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {r[0]: brute(r[1]) for r in rows}
    assert all(fp % (1 << 64) == fps[i] for i, fp, _ in got)
    ids = [r[0] for r in rows]
    root = classes(len(rows), lambda i, j: bin(fps[ids[i]] ^ fps[ids[j]]).count("1") <= 3)
    least = defaultdict(list)
    for i, r in zip(ids, root):
        least[r] += [i] * (i is not None)
    want = {(i, min(least[r])) for i, r in zip(ids, root)}
    assert {(i, c) for i, _, c in got} == want
    kept = simhash.drop_near_duplicates(docs, shingle=3)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").select("doc_id").collect()) == sorted({c for _, c in want}) and kept.columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_in_dense_and_split_groups(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for chunk in (8, 4096):
        found = simhash.links(spark.createDataFrame(signed, "fp long"), chunk=chunk)
        got = {(a % (1 << 64), b % (1 << 64)) for a, b in found.collect()}
        at = {f: i for i, f in enumerate(fps)}
        links = {(at[a], at[b]) for a, b in got}
        assert classes(len(fps), lambda i, j: (i, j) in links or (j, i) in links) == classes(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)


@pytest.mark.parametrize("most_open", [1, 3])
def test_packing_covers_every_id_once(spark, docs, empty, most_open):
    size = 64
    rows = packing.pack(docs, size=size, most_open=most_open, max_padding=2, fold=2).collect()
    e = tokens.encoder(tokens.default_tokenizer())
    want = Counter((r[0], e.encode((r[1] or "").encode()) + b"\1\0\0\0") for r in corpus())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(p["length"] for p in pieces[:i]) for i in range(len(pieces))]
        total = sum(r["length"] for r in pieces)
        assert size - 2 <= total <= size or total & (total - 1) == 0
    by = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by[r["doc_id"]].append(r)
    for i, pieces in by.items():
        copies = sum(n for (d, _), n in want.items() if d == i)
        assert sum(r["length"] for r in pieces) == copies * pieces[0]["doc_tokens"]
        if copies == 1:
            pieces.sort(key=lambda r: r["start"])
            assert want[(i, b"".join(bytes(r["ids"]) for r in pieces))] == 1
    assert packing.pack(empty).count() == 0


def test_store_round_trip_and_damage(spark, docs, empty):
    path, e = new_path(spark, "store"), tokens.encoder(tokens.default_tokenizer())
    store.write(docs, path)
    want = sorted(((r[0], e.encode((r[1] or "").encode()) + b"\2\0\0\0") for r in corpus()), key=lambda x: (x[0] is not None, x[0]))
    got = sorted(store.read(spark, path).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], np.array(r["ids"], "<u4").tobytes()) for r in got] == want
    at = 0
    for r, (i, ids) in zip(sorted(store.digests(spark, path).collect(), key=lambda r: r["start"]), want):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.select("id").distinct().count() == chunks.count()
    broken = new_path(spark, "broken")
    for t in ("recipes", "manifest", "root"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{broken}/{t}")
    chunks.withColumn("body", F.when(F.length("body") > 20, F.concat(F.lit(b"xx"), F.substring("body", 3, 100_000))).otherwise(F.col("body"))).write.parquet(f"{broken}/chunks")
    with pytest.raises(Exception, match="does not verify"):
        store.digests(spark, broken).collect()
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    damages = {
        "recipes": [recipes.withColumn("names", F.reverse("names")), recipes.withColumn("doc_id", F.col("doc_id") + 100), recipes.where("at <> 0"), recipes.where(F.col("part") != manifest.agg(F.min("part")).first()[0])],
        "manifest": [manifest.where(F.col("part") != manifest.agg(F.min("part")).first()[0]), manifest.withColumn("tokens", F.col("tokens") + 1)],
    }
    for table, versions in damages.items():
        for version in versions:
            harmed = new_path(spark, "harmed")
            for t in ("chunks", "recipes", "manifest", "root"):
                (version if t == table else spark.read.parquet(f"{path}/{t}")).write.parquet(f"{harmed}/{t}")
            for read in (store.digests, store.read):
                with pytest.raises(Exception, match="does not verify"):
                    read(spark, harmed).collect()
    gone = new_path(spark, "gone")  # a part that is missing from recipes and manifest alike
    least = manifest.agg(F.min("part")).first()[0]
    for t in ("chunks", "recipes", "manifest", "root"):
        table = spark.read.parquet(f"{path}/{t}")
        (table.where(F.col("part") != least) if "part" in table.columns else table).write.parquet(f"{gone}/{t}")
    with pytest.raises(Exception, match="does not verify"):
        store.digests(spark, gone).collect()
    none = new_path(spark, "none")
    store.write(empty, none)
    assert store.digests(spark, none).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 30_000).astype(np.uint32)
    bounds = np.array([0, 5, 5, 140, 20_000, 30_000])
    assert store.cuts_of(ids, bounds) == [store.cuts(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
    ends = store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= store.MOST and sizes[:-1].min() >= store.LEAST
    moved = store.cuts(np.concatenate([ids[:777], ids]))
    assert len({e - 777 for e in moved} & {*ends}) > 0.9 * len(ends)


def test_crc_of_joined_parts():
    parts = [bytes([i]) * (4 * n) for i, n in enumerate((1, 5, 3000, 1, 2_000_000))]
    after = np.cumsum([len(p) // 4 for p in parts][::-1])[::-1] - [len(p) // 4 for p in parts]
    moved = crc.Joiner(4).shifted(np.array([zlib.crc32(p) for p in parts], np.uint32), after)
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(b"".join(parts))


def test_quality_counts_equal_brute_force():
    def brute(t):
        w = (t or "").encode().split()
        g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        ls = [x for x in (t or "").split("\n") if x.encode().split()]
        return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(ls), sum(x in ls[:i] for i, x in enumerate(ls)), len(cover))

    rng = random.Random(2)
    texts = [None, "", "é # |", *("".join(rng.choice(["a ", "b ", "c\n", "d|", " "]) for _ in range(rng.randint(1, 80))) for _ in range(300))]
    for t in texts:
        assert quality_counts.counts(t.encode() if t is not None else None) == brute(t), t


def test_quality_thresholds(spark, empty):
    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randint(0, 9999)) for _ in range(40))
    rows = [(i, clean(), "en", "hot" if i % 3 else None, 0, 0, 0, "", 0) for i in range(400)]
    rows += [(1000 + i, " ".join(x + "%%%%" for x in clean().split()), "en", "hot", 0, 0, 0, "", 0) for i in range(10)] + [(2000, None, None, None, 0, 0, 0, "", 0), (2001, "few words", "en", "a", 0, 0, 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(df).collect()}
    assert verdict == {i: (False, True) if i < 1000 else (False, False) if i < 2000 else (True, False) for i in verdict} and len(verdict) == len(rows)
    assert sorted(r["doc_id"] for r in quality.quality_filter(df).collect()) == [*range(400)] and quality.quality_filter(df).columns == df.columns
    assert quality.judge(empty).count() == quality.quality_filter(empty).count() == 0


def test_quality_fences_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), *(rng.choice([0, 0, rng.randint(0, 900)]) for _ in range(4))) for _ in range(700)]
    df = spark.createDataFrame(rows, "lang string, source string, word_length long, symbol_share long, line_share long, repeat_share long")
    got = {(r["lang"], r["source"]): r for r in quality.thresholds(quality.sketches(df)).collect()}
    low_bits = lambda v: v >> max(0, v.bit_length() - 7) << max(0, v.bit_length() - 7)
    assert set(got) == {r[:2] for r in rows}
    for k, (rate, (_, tenths)) in enumerate(quality.RATES.items()):
        values = [(r[0], r[1], low_bits(r[2 + k])) for r in rows]
        for lang, source in got:
            w = Counter()
            for keep, scale in ((lambda v: v[:2] == (lang, source), None), (lambda v: v[0] == lang, 1), (lambda v: True, 1)):  # noqa: B023
                level = Counter(v[2] for v in values if keep(v))
                for b, n in level.items():
                    w[b] += quality.UNIT * n if scale is None else quality.PRIOR * quality.UNIT * n // sum(level.values())
            total, upto, q = sum(w.values()), 0, {}
            for b in sorted(w):
                upto += w[b]
                for i in (1, 2, 3):
                    if 4 * upto >= i * total:
                        q.setdefault(i, b)
            tail = lambda side: (lambda n: sum(x * abs(b - q[2]) for b, x in n) // sum(x for _, x in n) if n else 0)([(b, x) for b, x in w.items() if (b - q[2]) * side > 0])  # noqa: E731, B023
            r = got[(lang, source)]
            assert r["high"][rate] == q[3] + quality.RANGES * (q[3] - q[1]) + tenths * tail(1) // 10
            assert r["low"][rate] == q[1] - quality.RANGES * (q[3] - q[1]) - tenths * tail(-1) // 10


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert differences(llm_queries.queries()[name](spark, sf), connect(sf), llm_queries.oracle_sql()[name]) == []


def test_mixing_windows_and_deviation(spark, docs, empty):
    weights = {"a": 5, "b": 3, "c": 1, "d": 7}
    plan = mixing.schedule(weights)
    assert len(plan) == 16 and all(r <= slot < d for slot, _, _, r, d in plan)
    for t in range(1, 17):
        done = Counter(s for slot, s, *_ in plan if slot < t)
        assert all(abs(done[s] - t * w / 16) < 1 for s, w in weights.items())
    few = mixing.whole_weights({"x": 1.0, "y": 1e-9, None: 3.0}, 10)
    assert sum(few.values()) == 3 * mixing.SLOTS_A_SOURCE and few["y"] == 1
    many = {i: 1.0 for i in range(2000)} | {"hot": 1000.0}
    period = sum(mixing.whole_weights(many).values())
    assert abs(mixing.whole_weights(many)["hot"] / period - 1 / 3) < 0.001
    rows = mixing.mix(docs, block=2, bucket=5, slots=10).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in corpus())
    slots = defaultdict(list)
    for r in rows:
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
        slots[r["mix_slot"]].append((r["source"], r["mix_block"], r["mix_offset"]))
    for found in slots.values():
        assert len({x[:2] for x in found}) == 1 and sorted(x[2] for x in found) == [*range(len(found))]
    assert mixing.mix(empty).count() == 0 and mixing.mixed(docs, block=2).columns == docs.columns
    alike = {(r["doc_id"], r["source"]): r for r in mixing.mix(docs, block=2, bucket=1000, slots=10).collect() if r["doc_id"] is not None}
    assert all(alike[(r["doc_id"], r["source"])]["mix_slot"] == r["mix_slot"] for r in rows if (r["doc_id"], r["source"]) in alike)
    own = docs.withColumn("mix_notes", F.lit("n")).withColumn("mix_slot", F.lit("own")).withColumn("mix_block", F.col("doc_id"))
    back = mixing.mixed(own, block=2)
    assert back.columns == own.columns and {(r["mix_notes"], r["mix_slot"]) for r in back.collect()} == {("n", "own")}
    assert all(r["mix_block"] == r["doc_id"] for r in back.collect())


def test_html():
    page = "<html><head><title>T</title><script>if(a<b){}</script></head><body><nav>Menu</nav><div class='cookie-notice'>Cookies</div><article><h1>Head &amp; more</h1><p>First <b>bold</b>\n text<p>Second&nbsp;one<br>Third<ul><li>x<li>y</ul></article><div id=comments>Nice</div><footer>c</footer>"
    assert htmltext.main_text(page) == "Head & more\nFirst bold text\nSecond one\nThird\nx\ny"
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p></p>") == ""
    assert htmltext.main_text("<div><a href=x>Home</a> <a href=y>News</a></div><p>" + "Long text of the page itself. " * 5 + "</p>").startswith("Long text")
    assert htmltext.main_text("<p>broken <b>mark<i>up").startswith("broken markup")


def test_html_regions_follow_their_ratios():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    for _ in range(60):
        lines = [words(rng.randint(1, 6)), *(words(rng.randint(1, 120)) for _ in range(rng.randint(1, 9)))]
        body = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])
        page = lambda tag: f"<html><body><nav><ul>{''.join(f'<li><a href=x>{words(2)}</a></li>' for _ in range(5))}</ul></nav><div class='ad'>{words(8)}</div><{tag}>{body}</{tag}><div id='comments'><p>{words(30)}</p></div><footer>&copy; {words(6)}</footer>"  # noqa: E731, B023
        assert htmltext.main_text(page("article")) == htmltext.main_text(page("div")) == "\n".join(lines)


def test_html_smoothing_and_threshold_equal_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        v, r = [rng.random() * 9 for _ in range(rng.randint(1, 12))], []
        for _ in v:
            r.append(rng.randint(0, 2))
        got = htmltext.smoothed(v, r, 1.0)
        for i in range(len(v)):
            w = {j: math.exp(-((i - j) ** 2) / 2) * (1 if r[i] == r[j] else htmltext.BORDER) for j in range(len(v)) if abs(i - j) <= 2}
            assert math.isclose(got[i], sum(v[j] * w[j] for j in w) / sum(w.values()))
        cut = htmltext.threshold(v)
        low, high = [x for x in v if x < cut], [x for x in v if x >= cut]
        assert not low or math.isclose(cut, (sum(low) / len(low) + sum(high) / len(high)) / 2)


def test_html_without_ratios_is_another_text(monkeypatch):
    page = "<nav><a href=x>Menu</a></nav><div>" + "".join(f"<p>{'words of a paragraph ' * 9}</p>" for _ in range(4)) + "</div><footer>Some words at the foot</footer>"
    right = htmltext.main_text(page)
    monkeypatch.setattr(htmltext, "smoothed", lambda v, r, s: [9.0] * len(v))
    assert htmltext.main_text(page) != right and "Menu" in htmltext.main_text(page) and "Menu" not in right


def test_html_frame(spark):
    deep = "<div>" * 3000 + "<p>" + "long words " * 5000 + "</p>"
    rows = [(1, "<p>a b c</p>", "own"), (2, None, "own"), (2, None, "own"), (3, deep, "own"), (4, "", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    want = [(1, "a b c"), (2, ""), (2, ""), (3, ("long words " * 5000).strip()), (4, "")]
    assert [(r["page_id"], r["text"]) for r in htmltext.extract(df).orderBy("page_id").collect()] == want
    assert {(r["text"], r["main"]) for r in htmltext.extract(df, to="main").where("page_id = 1").collect()} == {("own", "a b c")}
    assert htmltext.extract(df.limit(0)).count() == 0


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    x[7] = x[8]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (None, [1.0] * 16), (3, [float(v) for v in x[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = additive.search(df, df.where("vec_id % 100 = 0"), k=10, codebooks=4, entries=32, shortlist=200, block=128, query_block=4, part=100).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 1500, 100)}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hits += len({v for v, _ in found} & {*best.tolist()})
        assert len(found) == 10 and all(abs(d[v] - s) < 1e-9 for v, s in found) and found == sorted(found, key=lambda p: (p[1], p[0]))
    assert hits >= 0.9 * 10 * len(got)
    clash = df.withColumn("id", F.lit("x")).withColumn("vector", F.lit(0)).withColumn("cell", F.lit(None))
    again = additive.search(clash, clash.where("vec_id % 100 = 0"), k=10, codebooks=4, entries=32, shortlist=200, block=128, query_block=4, part=100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    few = additive.search(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert [r["rank"] for r in sorted(few)] == [1, 2, 3] and additive.search(df.where("vec_id < 0"), df).count() == 0


def test_nearest_neighbours_visit_cells_by_one_rule(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centers, held = rng.normal(size=(8, 4)), np.array([3, 0, 5, 1, 2, 9, 4, 6])
    for visits in (1, 3, 8):
        for least in (1, 4, 12, 1000):
            for row, cells in zip((x := rng.normal(size=(20, 4))), additive.cells_of(x, centers, visits, held, least)):
                order = np.argsort(((centers - row) ** 2).sum(1)).tolist()
                n = next((n for n in range(visits, 8) if sum(held[order[:n]]) > least), 8)
                assert cells.tolist() == order[:n]
    # 900 rows were below a limit under which every cell was visited
    asked, real = [], additive.cells_to_visit
    monkeypatch.setattr(additive, "cells_to_visit", lambda *a: asked.append(real(*a)) or 1)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(900, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = additive.search(df, df.where("vec_id % 100 = 0"), codebooks=4, entries=32, shortlist=300).collect()
    assert len(asked) == 1 and len(out) == 90


@pytest.mark.parametrize("most", [additive.SAMPLE, 50])
def test_nearest_neighbours_leave_a_task_once_a_query(monkeypatch, most):
    rng, short = np.random.default_rng(4), 20
    monkeypatch.setattr(additive, "HELD", most, raising=False)
    books = additive.Codebooks(rng.normal(size=(2, 8, 4)))
    x, rows, scores = rng.normal(size=(3, 4)), [], defaultdict(list)
    for cell in range(30):
        # cells differ in the queries that visit them, and hold copies
        asked = [q for q in range(3) if (cell + q) % 3]
        ids, codes, norms = np.arange(cell * 15, cell * 15 + 15), rng.integers(0, 8, (15, 2)), rng.integers(0, 3, 15).astype("<f4")
        codes[5:9] = codes[5]
        norms[5:9] = 0
        rows.append([np.array(asked, "<i8").tobytes(), x[asked].astype("<f8").tobytes(), ids.astype("<i8").tobytes(), codes.astype("<u2").tobytes(), norms.tobytes()])
        for q in asked:
            tables = (-2 * x[q] @ books.flat.T).astype(np.float32).reshape(2, 8)
            scores[q] += [(norms[i] + tables[0, codes[i, 0]] + tables[1, codes[i, 1]], int(ids[i])) for i in range(15) if ids[i] != q]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["qids", "qvectors", "ids", "codes", "norms"])
    got = defaultdict(list)
    for out in additive._scored(books, short, 64)([batch]):
        for q, i, s in zip(*[c.to_pylist() for c in out.columns]):
            got[q].append((s, i))
    for q in range(3):
        assert [i for _, i in sorted(got[q])[:short]] == [i for _, i in sorted(scores[q])[:short]]
        assert most == 50 or len(got[q]) == short


def test_nearest_neighbours_recall_on_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [r for r in table.collect() if r["embedding"] is not None and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = defaultdict(set)
    for r in additive.search(table, table.where("vec_id % 100 = 0"), shortlist=200).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = wanted = 0
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits, wanted = hits + len({*best.tolist()} & got[q]), wanted + 10
    assert hits >= 0.95 * wanted


def test_line_dedup(spark, empty):
    near = " ".join(f"word{i}" for i in range(120))
    rows = [(1, "one two three four\nkeep me here now\nx", "own"), (2, "One, two  THREE four!\nother text that differs\nx\n", "own"), (3, None, "own"), (4, "", "own"), (None, "one two three four\nlast line of its own", "own"), (7, "other text that differs", "own"), (8, "one two three four", "own"), (8, "one two three four", "own"), (10, near, "own"), (11, near + " x", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = lines.dedup_lines(df, counts=True, least_words=3).collect()
    texts = defaultdict(list)
    for r in got:
        texts[r["doc_id"]].append(r["text"])
    assert texts == {1: [rows[0][1]], 2: ["other text that differs\nx\n"], 3: [None], 4: [""], None: ["last line of its own"], 7: [""], 8: ["", ""], 10: [near], 11: [""]}
    assert lines.dedup_lines(empty).count() == 0 and lines.dedup_lines(df).columns == df.columns


def test_line_dedup_finds_edited_lines(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows = []
    for n in [*range(4, 31)] * 3:
        line = [word() for _ in range(n)]
        edited = [*line]
        at = rng.randrange(n)
        edited[at] = word()[: len(line[at])] if n >= 12 else line[at][:-1] + "z"
        rows += [(len(rows), " ".join(line), 1), (len(rows) + 1, " ".join(edited), 0)]
    rows += [(len(rows), "contents", 1), (len(rows) + 1, "Contents!", 0), (len(rows) + 2, "contenst", None), (len(rows) + 3, "see also", 1), (len(rows) + 4, "see also", 0), (len(rows) + 5, "introduction", 1), (len(rows) + 6, "introductin", 0), (len(rows) + 7, "planning several larger gardens today", 1), (len(rows) + 8, "plannink several larger gardenz today", 0)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, kept int").drop("kept"), least_words=1).collect()}
    assert [i for i, t, kept in rows if kept == 1 and got[i] != t] == []
    assert [i for i, _, kept in rows if kept == 0 and got[i] != ""] == []


def test_line_dedup_links_all_lines_of_few_words(spark):
    rng = random.Random(31)
    rows = ["alpha bravo charl", "alphx bravx charx", "onelongword" * 4, "onelongword" * 3 + "onelongwurd", "seven words of which many are edited", "sevem wurds of whixh mamy are edited"]
    for _ in range(60):
        line = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 7)))
        rows.append(line)
        for _ in range(3):
            c = [*line]
            for _ in range(rng.randint(1, max(1, len(line) // 5))):
                i, kind = rng.randrange(len(c)), rng.randrange(3)
                c[i : i + (kind != 0)] = [] if kind == 1 and len(c) > 1 else [rng.choice("abcdefgh ")]
            rows.append(" ".join("".join(c).split()) or "x")
    rows = sorted({*rows}, key=lambda t: (len(t.split()) > 7, t))
    nodes = spark.createDataFrame([(i, t, len(t.split()), len(t)) for i, t in enumerate(rows)], "node long, norm string, words int, chars int").cache()
    got = {(r["a"], r["b"]) for r in lines.links(nodes).collect()}
    other = nodes.select(*[F.col(c).alias(f"{c}2") for c in nodes.columns])
    near = F.expr("levenshtein(norm, norm2) <= 0.2 * greatest(chars, chars2) + 1e-9 AND least(words, words2) <= 7")
    want = {(r["node"], r["node2"]) for r in nodes.join(other, F.col("node") > F.col("node2")).where(near).collect()}
    root = classes(len(rows), lambda i, j: (i, j) in got or (j, i) in got)
    assert len(want) > 150 and [(rows[i], rows[j]) for i, j in want if root[i] != root[j]] == []


def test_line_runs_are_made_of_lines_of_few_words_only(spark, monkeypatch):
    rng, made = random.Random(8), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    rows = [" ".join(word() for _ in range(n)) for n in [7] * 4 + [8, 9, 10] * 40]
    nodes = spark.createDataFrame([(i, t, len(t.split()), len(t)) for i, t in enumerate(rows)], "node long, norm string, words int, chars int").cache()
    for name in [n for n in ("runs", "runs_of_longer") if hasattr(line_prints, n)]:
        whole = getattr(line_prints, name)
        monkeypatch.setattr(line_prints, name, lambda df, similar, whole=whole: made.append(whole(df, similar)) or made[-1])
    none = spark.createDataFrame([], "node long, root long")
    line_prints.few_words_pairs(nodes, none, 0.8).count()
    assert made and all(m.where("words > 7").isEmpty() for m in made)


def test_lines_texts_are_taken_from_lines_that_share_a_key(spark, monkeypatch):
    rng, seen, whole = random.Random(9), {}, lines.stored
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = [" ".join(word() for _ in range(40)) for _ in range(50)]
    rows += [" ".join([*r.split()[:-1], "edited"]) for r in rows[:5]]
    nodes = spark.createDataFrame([(i, t, len(t.split()), len(t)) for i, t in enumerate(rows)], "node long, norm string, words int, chars int").cache()

    def watched(df, name, *a):
        out = whole(df, name, *a)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(lines, "stored", watched)
    got = {tuple(sorted((r["a"], r["b"]))) for r in lines.links(nodes).collect()}
    assert got == {(i, 50 + i) for i in range(5)} and seen["line-keyed-texts"] == seen["led-texts"] == 10


def test_similar_texts_equal_whole_distances(spark):
    rng = random.Random(33)
    rows = [("a", "ab"), ("ab", "b"), ("abab", "ab"), ("aaaaaa", "aaaaa"), ("aaaaa", "aaaaaa"), ("é b é b é", "é b é b"), ("x", "x")]
    for _ in range(400):
        text = [rng.choice("abé𝛼 ") for _ in range(rng.randint(1, 80))]
        copy = [*text]
        for _ in range(rng.randint(0, 1 + len(text) // 4)):
            at = rng.randrange(len(copy) + 1)
            copy[at : at + rng.randint(0, 2)] = [rng.choice("abé𝛼 ") for _ in range(rng.randint(0, 2))]
        rows.append(("".join(text), "".join(copy) or "a"))
    got = spark.createDataFrame(rows, "x string, y string").select(lines.similar_texts("x", "y").alias("got"), F.expr("levenshtein(x, y) <= floor(0.2 * greatest(length(x), length(y)) + 1e-9)").alias("want"))
    got = got.collect()
    assert all(r["got"] == r["want"] for r in got) and 50 < sum(r["want"] for r in got) < len(got) - 50


def test_similar_texts_compare_what_differs_only(spark):
    rng = random.Random(34)
    text = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    rows = [(text, text[:at] + "x" * 400 + text[at:]) for at in range(2000, 20_000, 2000)]
    pairs = spark.createDataFrame(rows, "x string, y string").coalesce(1)
    began = time.monotonic()
    assert pairs.where(lines.similar_texts("x", "y")).count() == len(rows)
    # whole texts of this length are some 160 million cells a pair
    assert time.monotonic() - began < 15


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    kept = lambda: {p.name for p in Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getFile("x").toString()).parents[1].rglob("shuffle_*.data")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(name), kept()
    got = storage.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few", f"file://{tmp_path}/few")
    until = time.time() + 10
    while kept() - before and time.time() < until:
        time.sleep(0.2)
    assert kept() - before == set() and spark.conf.get(name) == was and got.count() == 7


def test_line_dedup_tells_rows_apart(spark):
    rows = [(None, "alpha beta gamma\nonly the first row has this"), (None, "alpha beta gamma\nanother text stands in here"), (None, "same in both rows"), (None, "same in both rows"), (5, "delta epsilon zeta\nalpha beta gamma"), (5, "delta epsilon zeta\nlines of their own remain"), (6, "delta epsilon zeta")]
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    left = Counter(line for _, t in got for line in t.split("\n") if line)
    assert len(got) == 7 and left == Counter({line for _, t in rows for line in t.split("\n")})
    assert [i for i, t in got if "alpha beta gamma" in t] == [5] and (6, "") in got


def test_line_prints_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["w", "x", "yy"]) + str(rng.randint(0, 40)) for _ in range(n)) for n in (1, 2, 8, 63, 126, 127, 128, 129, 700)]
    rows = [(i, t, len(t.split()), len(t)) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "node long, norm string, words int, chars int")
    hashed = {r["node"]: (r["h"], r["again"]) for r in nodes.select("node", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)).alias("h"), F.transform(F.split("norm", " "), lambda w: F.xxhash64(F.xxhash64(w))).alias("again")).collect()}
    bits = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    got = line_prints.prints(nodes).collect()
    assert len(got) == len(rows)
    for r in got:
        h, again = hashed[r["node"]]
        assert r["fp"] % (1 << 64) == bits(h) and (r["words"] > 127 or r["more"] % (1 << 64) == bits(again))
        for g in range(8):
            own = [x % (1 << 64) for x in h if (x % (1 << 64)) >> 3 & 7 == g]
            assert (r[f"b{g}"] or 0) == sum(x >> 24 for x in own)
            assert r["counts"] is None or r["counts"] >> 7 * g & 127 == len(own)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    base = [[word() for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 25, 40, 200]))] for _ in range(60)]
    def edited(words):
        words = [*words]
        for _ in range(rng.randint(0, 1)):  # so two differ in no more than two words, which blocks find for sure
            i = rng.randrange(len(words))
            words[i] = words[i][:-1] + "z" if len(words) < 12 else word()
        return " ".join(words).capitalize() + rng.choice(["", ".", " !"])
    rows = [(rng.choice([None, *range(25)]), "\n".join(rng.choice(["", "--", edited(rng.choice(base)), edited(rng.choice(base))]) for _ in range(rng.randint(1, 6)))) for _ in range(40)]
    rows += [(3, None), (4, ""), rows[0], rows[0]]
    def norm(line):
        return " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split())
    def distance(a, b):
        p = np.arange(len(b) + 1)
        y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
        for i, c in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32), 1):
            q = np.concatenate([[i], np.minimum(p[1:] + 1, p[:-1] + (y != c))])
            p = np.minimum.accumulate(q - np.arange(len(q))) + np.arange(len(q))
        return int(p[-1])
    nodes = sorted({norm(x) for _, t in rows for x in (t or "").split("\n")} - {""})
    near = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
    root = dict(zip(nodes, classes(len(nodes), lambda i, j: near(nodes[i], nodes[j]))))
    order = {h: i for i, h in enumerate(sorted({(r["t"] or "", r["h"]) for r in spark.createDataFrame(rows, "d long, t string").select("t", F.xxhash64("t").alias("h")).collect()}, key=lambda x: x[1]))}
    hashes = {t: h for t, h in order}
    seen, want = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1] or ""] if r[1] is not None else 0)):
        left = []
        for x in (t or "").split("\n"):
            k = root.get(norm(x))
            if k is None or k not in seen:
                left.append(x)
            seen |= {k} if k is not None else set()
        want.append((d, None if t is None else "\n".join(left)))
    got = [(r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key)


def test_passages(spark, empty):
    rng = random.Random(3)
    w = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    exact, fuzzy = w(60), w(120)
    edited = [x if rng.random() > 0.06 else "zz" + x for x in fuzzy]
    rows = [(i, " ".join(w(rng.randint(30, 300)))) for i in range(20)]
    rows += [(100, " ".join(w(50) + exact + w(50))), (101, " ".join(w(80) + exact + w(20))), (102, " ".join(w(40) + fuzzy + w(10))), (103, " ".join(w(10) + edited)), (104, " ".join(w(20) + exact[:40] + w(30))), (105, None), (106, ""), (None, " ".join(exact)), (101, "other")]
    df = spark.createDataFrame(rows[:-1], "doc_id long, text string")
    got = {(r["doc_id"], r["source_id"]): r for r in passages.repeated_passages(df).collect()}
    assert set(got) == {(101, 100), (103, 102)}
    a = got[(101, 100)]
    assert (a["start"], a["words"], a["source_start"], a["equal"]) == (80, 60, 50, 60)
    assert got[(103, 102)]["words"] > 105 and got[(103, 102)]["similarity"] >= 0.8
    left = {r["doc_id"]: r["text"] for r in passages.drop_repeated_passages(df).collect()}
    assert len(left[101].split()) == 100 and left[100] == rows[20][1] and left[105] is None
    assert passages.repeated_passages(empty).count() == 0
    both = spark.createDataFrame(rows, "doc_id long, text string")  # another row of id 101
    kept = [r["text"] for r in passages.drop_repeated_passages(both).where("doc_id = 101").collect()]
    assert len(kept) == 2 and "other" in kept
    assert passages.drop_repeated_passages(both).where("doc_id is null").first()["text"] == " ".join(exact)


def test_passages_between_two_later_documents(spark):
    rng = random.Random(21)
    w = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    p = w(80)
    rows = [(1, " ".join(w(30) + p[:40] + w(30))), (2, " ".join(w(30) + p[40:] + w(30))), (10, " ".join(w(20) + p + w(20))), (11, " ".join(w(25) + p + w(25)))]
    got = [(r["doc_id"], r["source_id"], r["start"], r["words"], r["equal"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(11, 10, 25, 80, 80)]


def test_passages_beyond_parts_in_other_documents(spark):
    rng = random.Random(22)
    w = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    p = w(80)
    # parts of 40 words stand in the smallest documents and in those right before 11, so 3 is neither for any seed
    rows = [(i, " ".join(w(30) + p[:40] + w(30))) for i in (1, 5)] + [(i, " ".join(w(30) + p[40:] + w(30))) for i in (2, 6)]
    rows += [(3, " ".join(w(20) + p + w(20))), (11, " ".join(w(25) + p + w(25)))]
    got = [(r["doc_id"], r["source_id"], r["start"], r["words"], r["equal"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(11, 3, 25, 80, 80)]


@pytest.mark.parametrize("size", [6, 80, 150, 2000])
def test_passages_of_long_words_are_whole(spark, size):
    rng = random.Random(size)
    w = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n)]
    rows = []
    for i in range(6):
        p = w(55)
        rows += [(2 * i, " ".join(w(60) + p + w(60))), (2 * i + 1, " ".join(w(70) + p + w(70)))]
    got = sorted((r["doc_id"], r["source_id"], r["start"], r["words"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2 * i + 1, 2 * i, 70, 55) for i in range(6)]


def test_passages_of_hot_and_other_seeds_are_the_same(spark, monkeypatch):
    rnd = random.Random(8)
    passage = [f"w{rnd.randrange(900)}" for _ in range(70)]
    rows = []
    for i in range(40):
        before, after = ([f"v{rnd.randrange(900)}" for _ in range(rnd.randrange(30))] for _ in range(2))
        rows.append((i, " ".join(before + (passage if i % 3 else []) + after)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for hot in (0, 100, 10_000):  # no hot seed, some, all
        monkeypatch.setattr(passages, "HOT", hot)
        found.append(sorted(map(tuple, passages.repeated_passages(docs).collect())))
    assert found[0] == found[1] == found[2]
    assert {r[0] for r in found[0]} == {i for i in range(40) if i % 3} - {1}


def test_seeds_in_common_are_dealt_from_the_smaller_document(spark, monkeypatch):
    rng, kept, whole = random.Random(6), {}, passages.stored
    held = {d: [rng.randrange(40) for _ in range(200 if d in (0, 30) else rng.randint(1, 6))] for d in range(31)}
    rows = [(h, d, 0, False, i, 2 * i, i % 3, i % 5) for d, hs in held.items() for i, h in enumerate(hs)]
    shared = spark.createDataFrame(rows, "h long, doc long, other long, hot boolean, pos int, off int, lo int, hi int")
    pairs = [(30, d) for d in range(30)] + [(d, 0) for d in range(1, 30)]
    monkeypatch.setattr(passages, "stored", lambda df, name, *a: kept.setdefault(name, whole(df, name, *a)))
    got = sorted((r["doc"], r["other"], r["pos"], r["o"]["pos"]) for r in passages._in_common(spark.createDataFrame(pairs, "doc long, other long"), shared).collect())
    assert got == sorted((d, o, i, held[o].index(h)) for d, o in pairs for i, h in enumerate(held[d]) if h in held[o])
    dealt = sum(len(held[r["doc"] if r["fewer"] else r["other"]]) for r in kept["pairs"].collect())
    assert dealt == sum(min(len(held[d]), len(held[o])) for d, o in pairs) < 600


def test_chain_prefers_collinear_anchors():
    anchors = [(0, 100, 10), (12, 112, 10), (15, 500, 8), (24, 124, 10), (400, 130, 9)]
    best = passages.chains(anchors)[0]
    assert best == [(0, 100, 10), (12, 112, 10), (24, 124, 10)]


def test_hmm_scores(spark, docs, empty):
    out = hmm.score(docs, head=50, lookup=80, states=3, rounds=2).collect()
    rows = [r for r in corpus()]
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    text = lambda i: "" if i is None else str(i)
    count = Counter(w for r in rows if zlib.crc32(text(r[0]).encode()) % 7 != 2 for w in words(r[1]))
    n, v = sum(count.values()), len(count)
    by = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    for r in out:
        w = words(by[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(text(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in count for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert hmm.score(empty).count() == 0


def test_forward_equals_all_paths():
    rng = np.random.default_rng(2)
    start, move, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T
    model, seqs = hmm.Model(start, move, emit), [np.array([0, 4, 2, 1]), np.array([3, 3]), np.array([2])]
    import itertools

    for s, got in zip(seqs, model.forward(seqs)):
        p = sum(start[z[0]] * emit[s[0], z[0]] * math.prod(move[z[t - 1], z[t]] * emit[s[t], z[t]] for t in range(1, len(s))) for z in itertools.product(range(3), repeat=len(s)))
        assert math.isclose(got, math.log(p))
    starts, moves, counts = model.expected(seqs)
    assert math.isclose(starts.sum(), 3) and math.isclose(moves.sum(), 4) and math.isclose(counts.sum(), 7)


def test_expected_counts_equal_all_paths_and_pieces():
    import itertools

    rng = np.random.default_rng(4)
    start, move, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T
    model, seq = hmm.Model(start, move, emit), np.array([0, 4, 2, 1, 3, 3])
    total, want = 0.0, (np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)))
    for z in itertools.product(range(3), repeat=len(seq)):
        p = start[z[0]] * emit[seq[0], z[0]] * math.prod(move[z[t - 1], z[t]] * emit[seq[t], z[t]] for t in range(1, len(seq)))
        total += p
        want[0][z[0]] += p
        for t in range(len(seq)):
            want[2][seq[t], z[t]] += p
            if t:
                want[1][z[t - 1], z[t]] += p
    for got in (model.expected([seq]), model.expected_long(seq, 100), model.expected_long(seq, 2), model.expected_long(seq, 1)):
        for g, w in zip(got, want):
            assert np.allclose(g, w / total)


def test_lexicon_has_no_cliff(spark):
    words = spark.createDataFrame([(f"w{i}".encode(), 0, 7) for i in range(400)] + [(hmm.END, 0, 50)], "word binary, bin int, c long")
    lex = hmm.lexicon(words, head=100, lookup=100)
    assert 60 <= len(lex.index) <= 140 and lex.head <= 100 and lex.tokens == 2850
