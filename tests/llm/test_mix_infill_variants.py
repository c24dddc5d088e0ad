"""Source mix, fill-in-the-middle and spelling variants against brute force and their SQL, and on the edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.llm import infill, mixing, queries, variants

D = "/root/testdata/sf0.001"
LONG = "word " * 30_000
TEXTS = [None, "", " \n\t", "one", "Same text here twice.", "Same text here twice.", LONG]
SCHEMA = "doc_id bigint, text string, lang string, source string, size string, taken string, fim string, _cut string, n string, word string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated texts, a null id and source, and columns that clash with results."""
    rows = [(i if i else None, t, None, "s" if i % 2 else None, *"abcdef") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (4, TEXTS[4], "en", None, *"abcdef")], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.mark.parametrize("name", ["op11_source_mix", "op12_fill_in_middle"])
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracle import compare

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    got = queries.REGISTRY[name](spark, D).toPandas()
    assert len(got) and compare(got, con.execute(queries.SQL[name]).df()) == "ok"


# --- mix ---------------------------------------------------------------------------------------


def levelled(sizes, weights, share, most):
    """Targets by sharing out again what the full sources cannot take."""
    target, full = {}, set()
    budget = share * sum(sizes.values())
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        if not free:
            return {s: most * sizes[s] for s in sizes}
        target = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target | {s: most * sizes[s] for s in full}
        full |= set(over)


def mix_of(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return [r.asDict() for r in mixing.mixed(docs, **how).collect()]


def check_mix(rows, out):
    by_source = defaultdict(list)
    for r in out:
        by_source[r["source"]].append(r)
    names = sorted((s for s in by_source if s is not None)) + [s for s in by_source if s is None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(r["size"] for r in by_source[s]) for s in names}
    want = levelled(sizes, weights, 1.5, 2.0)
    assert sorted((r["doc_id"] or 0) for r in out) == sorted((r[0] or 0) for r in rows)
    for s in names:
        assert all(r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] for r in by_source[s])
        assert 0 <= want[s] - sum(r["taken"] for r in by_source[s]) < 1 or sizes[s] == 0
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in by_source[s])
        # Complete epochs come first: the rows differ by at most one epoch, and at most one stands at the cut.
        epochs = int(want[s]) // sizes[s] if sizes[s] else 0
        extra = [r["taken"] - epochs * r["size"] for r in by_source[s]]
        assert sum(0 < e < r["size"] for e, r in zip(extra, by_source[s], strict=True)) <= 1


@pytest.mark.parametrize("few", [3, 50_000])
def test_mix_reaches_its_targets_at_every_size(spark, few):
    rng = random.Random(5)
    rows = [
        (i, "w " * rng.choice([0, 1, 3, 40, 500]), rng.choice(["a"] * 9 + ["b", "c", "d", "é", None]))
        for i in range(1, 400)
    ]
    out = mix_of(spark, rows, few=few)
    check_mix(rows, out)
    again = mix_of(spark, rows[::-1], few=50_000)
    key = lambda r: r["doc_id"]
    assert sorted(out, key=key) == sorted(again, key=key)


def test_mix_cuts_within_a_group_of_repeated_rows(spark):
    rows = [(7, "two words", "a")] * 90 + [(None, "", "b"), (8, "one two three", "b")] + [(9, "x " * 50, "c")] * 3
    out = mix_of(spark, rows, few=4)
    check_mix(rows, out)


def test_mix_prefers_documents_of_higher_weight(spark):
    rows = [(i, f"text {i} " * 20, "a") for i in range(1, 2001)]
    heavy = F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0)
    taken = Counter()
    for r in mix_of(spark, rows, weight=heavy):
        taken[r["doc_id"] % 2] += r["taken"] - r["size"]
    # Half of the words are taken once more. With weights of 8 and 1 the halves split 1 - x**8 to 1 - x, x = 0.894.
    assert taken[0] / (taken[0] + taken[1]) == pytest.approx(0.853, abs=0.03)


def test_mix_has_defined_results_for_odd_rows(spark, odd):
    out = mixing.mixed(odd).collect()
    assert len(out) == 8 and sum(r["size"] == 0 for r in out) == 3
    assert all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert mixing.mixed(odd, carry=("doc_id", "lang", "size")).columns[:2] == ["doc_id", "lang"]
    assert mixing.mixed(odd.where("false")).collect() == []
    for weight in (F.lit(None).cast("double"), F.lit(float("nan")), F.lit(-1.0)):
        assert len(mixing.mixed(odd, weight=weight).collect()) == 8


# --- fill in the middle ----------------------------------------------------------------------------


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_wavelet_matrix_ranks_every_symbol_at_every_place():
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 500):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix, places = infill.WaveletMatrix(symbols, 3), np.arange(size + 1)
        for symbol in range(8):
            assert matrix.rank(symbol, places).tolist() == [int((symbols[:p] == symbol).sum()) for p in places]


def test_infill_equals_cutting_lists_of_units(spark, docs, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab Zé\n漢🙂<>PSM", k=rng.randrange(30))) for _ in range(600)]
    texts += ["<", "<S", "a<S", "x<P>y", "<M", "ab" * 20_000, "🙂" * 3_000, LONG, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "No id here"), (5, "Again"), (5, "Again")]
    rows += [(r["doc_id"], r["text"]) for r in docs.collect()]
    monkeypatch.setattr(infill, "BLOCK", 500)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = infill.infilled(frame).select("doc_id", "text", "fim.*", infill.restored(F.col("fim.output"), F.col("fim.form")).alias("back"))
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_infill(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_infill_has_defined_results_for_odd_rows(odd):
    out = infill.infilled(odd)
    assert out.columns == odd.columns and len(out.collect()) == 8
    assert infill.infilled(odd.where("false")).collect() == []
    assert len(infill.digests(odd).collect()) == 8


# --- spelling variants -------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows, least_chars=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    # Candidates by deletion only, each confirmed by comparing the words.
    holes = defaultdict(set)
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes[key].add(w)
    links = defaultdict(set)
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            links[w] |= {v for v in holes[key] if near(w, v)}
    form = {}
    for w, n in counts.items():
        best = min(links[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(links[w]), counts.get(form[w]))
    return out


def as_map(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_equal_comparing_all_words(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = ["".join(rng.choices("aabÀ", k=rng.randrange(5, 9))) for _ in range(40)]
        rows.append((i, " ".join(words) + " AaBBaa÷à aabbaa " + "aabbaab " * rng.randrange(4)))
    rows += [(None, None), (None, "aabbaa"), (3, ""), (4, "aaaaaa " * 5_000)]
    got = as_map(variants.document_variants(spark.createDataFrame(rows, "doc_id bigint, text string")))
    want = brute_variants(rows)
    assert got == want and any(v[1] not in (v[0], w) and v[0] for w, v in want.items())


def test_variants_of_the_given_documents(spark, docs):
    want = brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert as_map(queries.op13_spelling_variants(spark, D)) == want
    assert sum(v[0] is not None for v in want.values()) > 10


def test_near_pairs_are_found_once(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 7))) for _ in range(200)})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    got = [(r["a"], r["b"]) for r in variants.near_pairs(frame).collect()]
    want = {(a, b) for a in words for b in words if a < b and near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_variants_have_defined_results_for_odd_rows(odd):
    assert as_map(variants.document_variants(odd)) == {}
    assert variants.document_variants(odd.where("false")).collect() == []
    assert as_map(variants.document_variants(odd, least_chars=4))["word"][2] > 29_000
