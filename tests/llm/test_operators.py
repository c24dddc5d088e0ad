"""Each operator against brute force or the library it has to agree with, and on the defined edge cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helioframe.llm import (
    bpe,
    chat,
    decontam,
    licenses,
    near_dups,
    placement,
    pseudonyms,
    quality_rules,
    queries,
    rule_ensemble,
    text_stats,
    token_counts,
)

D = "/root/testdata/sf0.001"
LONG = "word " * 30_000
TEXTS = [None, "", " \n\t", "one", "Same text here twice.", "Same text here twice.", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated texts, a null id, and columns that clash with inner names."""
    rows = [(i if i else None, t, None, "s", None, "x", "y") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s", 1, "x", "y")]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _found string, _stats string"
    )


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_suffix_search_equals_scanning():
    rng = random.Random(3)
    vocabulary = [b"a", b"b", b"c", b"zz"]
    for window in (1, 3, 10):
        texts = [b" ".join(rng.choices(vocabulary, k=rng.randrange(40))) for _ in range(30)]
        items = [(str(i), rng.choices(vocabulary[:3], k=rng.randrange(1, 14))) for i in range(6)]
        found = decontam.found_in(texts, decontam.TestSuffixes.build(items, window))
        for text, got in zip(texts, found, strict=True):
            words, hit, names = text.split(), set(), set()
            for name, item in items:
                n = min(window, len(item))
                for q, p in itertools.product(range(len(item) - n + 1), range(len(words) - n + 1)):
                    if item[q : q + n] == words[p : p + n]:
                        hit |= set(range(p, p + n))
                        names.add(name)
            spans = got["spans"]
            marked = {k for a, b in zip(spans[::2], spans[1::2], strict=True) for k in range(a, b)}
            assert (marked, got["items"]) == (hit, sorted(names))


def test_longest_match_and_blocks(spark, odd):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"x {passage.upper()} y"), (2, "nothing of it")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, f"q {passage} r"), (8, None), (9, "x")], "item_id bigint, text string")
    assert [tuple(r) for r in decontam.longest_matches(docs, bench).where("item_id = '7'").collect()] == [(1, "7", 1, 1, 15)]
    whole = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    # Blocks of a few words: several look-ups and written passes give the same.
    assert sorted(map(tuple, decontam.contamination(docs, bench, block_words=12).collect())) == whole
    assert decontam.decontaminated(docs, bench).columns == docs.columns
    assert decontam.decontaminated(odd, bench).count() == odd.count()
    assert decontam.contamination(odd.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", lower(text))
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(sets[i]), find(i), i == find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, size, percent, monkeypatch):
    monkeypatch.setattr(near_dups, "MEMBERS", 8)
    rng = random.Random(size)
    rows = [(i, t) for i, t in enumerate([None, "", "  ", "one", "One", "two words", LONG])]
    for _ in range(4):
        base = [f"b{rng.randrange(10**6)}" for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(30):
            copy = base[:]
            for _ in range(rng.randrange(0, len(base) // 8)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in near_dups.near_duplicates(frame, size, percent).collect()}
    want = brute_components(rows, size, percent)
    assert got == want
    kept = near_dups.deduplicated(frame, size, percent)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k in want if k}


def test_near_duplicates_odd_rows(odd):
    assert near_dups.near_duplicates(odd).count() == odd.count()
    assert near_dups.deduplicated(odd).columns == odd.columns
    assert near_dups.near_duplicates(odd.limit(0)).count() == 0


def test_feistel_is_a_bijection_within_the_format(spark):
    cards = [f"4{i:014d}" for i in range(300)]
    cards = [c + str(next(k for k in range(10) if luhn(c + str(k)))) for c in cards]
    values = (
        cards
        + [f"10.0.{i}.7" for i in range(256)]
        + [f"19{i:02d}-02-28" for i in range(100)]
        + [f"+1 (366) 555-{i:04d}" for i in range(200)]
        + [f"123-45-{i:04d}" for i in range(1, 100)]
        + [f"ab{i}@mail.example.com" for i in range(100)]
    )
    frame = spark.createDataFrame([(v, f"x {v} y, {v}") for v in values], "value string, text string")
    rows = pseudonyms.pseudonymised(frame, key="k", count="n").collect()
    seen = Counter()
    for r in rows:
        first, second = re.fullmatch("x (.*) y, (.*)", r.text).groups()
        assert first == second
        seen[first] += 1
        assert re.fullmatch(pseudonyms.ANY, first)
        if r.value in cards:
            assert luhn(first) and len(first) == 16
    assert max(seen.values()) == 1
    other = pseudonyms.pseudonymised(frame, key="another").collect()
    assert sum(a.text != b.text for a, b in zip(rows, other, strict=True)) > 0.95 * len(rows)


def luhn(number):
    digits = [int(c) for c in number[::-1]]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_leave_other_text(spark, odd):
    said = ["4111 1111 1111 1112", "300.1.1.1", "2023-02-31", "000-12-3456", "version 1.2.3", "a@b"]
    frame = spark.createDataFrame([(s,) for s in said], "text string")
    assert [r.text for r in pseudonyms.pseudonymised(frame, key="k").collect()] == said
    same = pseudonyms.pseudonymised(odd, key="k")
    assert same.columns == odd.columns and same.exceptAll(odd).count() == 0


def test_statistics_equal_plain_counting(docs):
    rows = docs.select("text", text_stats.text_stats("text").alias("s")).collect()
    for text, s in rows[:80]:
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = list(zip(words, words[1:], words[2:], strict=False))
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = {k for i, w in enumerate(windows) if w in often for k in (i, i + 1, i + 2)}
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == (
            len(words),
            sum(map(len, words)),
            len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)),
            len(covered),
        )


def test_cutoffs_keep_their_limit(spark, odd):
    # The bound by exact enumeration: at the limit, so few rejections are seen with at most the level.
    assert quality_rules.binomial_cdf(0, 100, 0.05) == pytest.approx(0.95**100)
    assert quality_rules.binomial_cdf(100, 100, 0.05) == pytest.approx(1.0)
    assert not quality_rules.admissible(0, 50, 0.02, 0.001)
    assert quality_rules.admissible(0, 5000, 0.004, 0.0003)
    rows = [("en", 1, i / 10_000) for i in range(9000)] + [("en", 0, 0.95)] * 50 + [("fr", 1, 0.0)] * 10
    labelled = spark.createDataFrame(rows, "stratum string, label int, upper_share double")
    chosen = quality_rules.choose_cutoffs(labelled, grid={"upper_share": (0.91, 0.9, 0.89, 0.8)})
    # 0.89 rejects 99 of 9,000: too near to 2 %; 0.8 rejects a ninth. French has too few labels.
    assert chosen["en"]["upper_share"] in (0.9, 0.89) and chosen["fr"] == {}
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    got = quality_rules.quality_verdicts(odd, labels)
    assert got.count() == odd.count() and got.where("n_words = 0 and not base_failed").count() == 0
    assert quality_rules.kept_documents(odd, labels).columns == odd.columns
    assert quality_rules.quality_verdicts(odd.limit(0), labels.limit(0)).count() == 0


def test_cutoffs_are_chosen_from_few_labels_and_bound_the_joint_rate(spark):
    steps = quality_rules.ladder({"a": (3.0, 2.0), "b": (9.0,)})
    assert steps == [("a", 3.0), ("b", 9.0), ("a", 2.0)]
    grid = {"upper_share": (0.9, 0.5), "mark_share": (0.9, 0.5)}
    rows = [("en", 1, 0.0, 0.0)] * 228 + [("fr", 1, 0.0, 0.0)] * 227
    # Each rule alone rejects 1.5 % of the German documents at its second cutoff, both together 3 %.
    rows += [("de", 1, 0.0, 0.0)] * 9700 + [("de", 1, 0.6, 0.0)] * 150 + [("de", 1, 0.0, 0.6)] * 150
    labelled = spark.createDataFrame(rows, "stratum string, label int, upper_share double, mark_share double")
    chosen = quality_rules.choose_cutoffs(labelled, grid=grid)
    assert chosen["en"] == {"upper_share": 0.5, "mark_share": 0.5} and chosen["fr"] == {}
    assert chosen["de"] == {"upper_share": 0.5, "mark_share": 0.9}


def test_production_cutoffs_reject_the_bad_documents(spark):
    known = quality_rules.one_label(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    got = queries.op3_quality_rules(spark, "/root/testdata/sf0.1").where("not base_failed").join(known, "doc_id")
    rows = got.groupBy("stratum", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"), F.max("cutoffs").alias("c"))
    rows = {(r["stratum"], r["label"]): r for r in rows.collect()}
    for name in quality_rules.STRATA:
        good, bad = rows[name, 1], rows[name, 0]
        assert good["c"] and bad["n"] > 0 and bad["kept"] == 0
        assert good["n"] - good["kept"] <= quality_rules.FALSE_REJECTION * good["n"]


def test_placement_equals_taking_turns(spark, odd):
    names = ["a", "b", "c"]
    table = placement.lookup_table(names, 13)
    free, want = set(range(13)), {}
    orders = []
    for n in names:
        offset, skip = placement.number(n, "offset") % 13, placement.number(n, "skip") % 12 + 1
        orders.append([(offset + k * skip) % 13 for k in range(13)])
    for turn in itertools.cycle(range(3)):
        if not free:
            break
        slot = next(s for s in orders[turn] if s in free)
        free.remove(slot)
        want[slot] = turn
    assert table == [want[s] for s in range(13)]
    counts = Counter(placement.lookup_table(queries.SHARDS))
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(placement.lookup_table(queries.SHARDS), placement.lookup_table(queries.SHARDS[:-1]), strict=True))
    assert moved < 0.25 * placement.SLOTS
    got = placement.placed(odd, "doc_id", names, 13)
    assert got.count() == odd.count() and got.where("shard is null").count() == 0
    with pytest.raises(ValueError, match="prime"):
        placement.lookup_table(names, 12)


def test_log_folds_to_final_messages(spark, tmp_path):
    log = [
        (1, 0, "message", 0, "user", "Hi"),
        (1, 1, "message", 1, "assistant", ""),
        (1, 2, "delta", 1, None, "wro"),
        (1, 3, "delta", 1, None, "ng"),
        (1, 4, "message", 2, "user", "and?"),
        (1, 5, "regenerate", 1, None, None),
        (1, 6, "delta", 1, None, "right </turn> ### \\#"),
        (1, 7, "edit", 0, None, "Hello"),
        (2, 0, "delta", 0, None, None),
    ]
    frame = spark.createDataFrame(log, "conv_id bigint, seq bigint, kind string, message bigint, role string, text string")
    rows = chat.formatted_turns(frame).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, *chat.read_back(r.formatted)) for r in rows] == [
        (1, "user", "Hello"),
        (1, "assistant", "right </turn> ### \\#"),
        (2, "", ""),
    ]
    assert [r.formatted[r.loss_start : r.loss_end] for r in rows][1] == chat.escaped("right </turn> ### \\#")
    assert chat.conversation_digests(chat.formatted_turns(frame.limit(0))).count() == 0


def test_turns_come_back(spark):
    odd = ["", "a" * 512, "a" * 513, "\\", "\\\\###", "</turn>\n### user: x</turn>\n", "é\U0001f600" * 700, None]
    rows = [(5, i, "assistant" if i % 2 else "user:</turn>", t) for i, t in enumerate(odd)] * 2
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.conversation_digests(chat.formatted_turns(chat.log_of_turns(frame))).first()
    final = sorted(((t, r, s or "") for _, t, r, s in rows))
    assert got.n_turns == 16
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{s}\n" for _, r, s in final).encode()).hexdigest()
    loss = "".join(s for _, r, s in final if r == "assistant")
    assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_logs_of_turns_have_drafts_edits_and_regenerated_tails(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE", 4)
    rows = [(c, i, "assistant" if i % 2 else "user", f"{c} {i} " * i) for c in (1, 2) for i in range(30)]
    rows.append((3, 0, "user", "x\U0001f600" * 500_000))
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    log = chat.log_of_turns(frame, delta=16)
    counts = {r.kind: r["count"] for r in log.where("conv_id < 3").groupBy("kind").count().collect()}
    # Of 30 messages 8 have the remainder 1 by 4 and 4 the remainder 3 by 8.
    assert (counts["message"], counts["edit"], counts["regenerate"]) == (2 * (30 + 2 * 4), 2 * 8, 2 * 4)
    events = log.where("conv_id < 3").orderBy("conv_id", "seq").collect()
    for conv in (1, 2):
        told = chat.fold((e.kind, e.message, e.role, e.text) for e in events if e.conv_id == conv)
        assert told == [(r, t) for c, _, r, t in rows if c == conv]
    got = {r.conv_id: r for r in chat.conversation_digests(chat.formatted_turns(log)).collect()}
    for conv in (1, 2, 3):
        final = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == conv)
        assert got[conv].turns_sha256 == hashlib.sha256(final.encode()).hexdigest()


def test_blocks_fold_like_the_whole_log(spark, monkeypatch):
    rng = random.Random(8)
    kinds = ["message"] * 4 + ["delta"] * 5 + ["edit", "regenerate"]
    log = [(c, s, rng.choice(kinds), rng.randrange(12), rng.choice(["user", "assistant"]), f"{s} ") for c in (1, 2, None) for s in range(150)]
    rng.shuffle(log)
    schema = "conv_id bigint, seq bigint, kind string, message bigint, role string, text string"
    frame = spark.createDataFrame(log, schema)
    monkeypatch.setattr(chat, "RANGE", 3)
    rows = chat.formatted_turns(frame).collect()
    for conv in (1, 2, None):
        events = sorted((e for e in log if e[0] == conv), key=lambda e: e[1])
        got = sorted((r.turn, *chat.read_back(r.formatted)) for r in rows if r.conv_id == conv)
        assert got == [(k, *m) for k, m in enumerate(chat.fold(e[2:] for e in events))]
    # The blocks of one conversation lie in several partitions.
    one = spark.range(400).selectExpr("1L conv_id", "id seq", "'message' kind", "id message", "'user' role", "'x' text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = chat.formatted_turns(one).select(F.spark_partition_id().alias("p"), "turn").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.p for r in spread}) > 1 and sorted(r.turn for r in spread) == list(range(400))


def test_rules_score_held_out_labels(spark, odd):
    d = "/root/testdata/sf0.01"
    scores = queries.op7_rule_ensemble(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    right = scores.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.9
    none = labels.limit(0)
    got = rule_ensemble.quality_scores(odd, none)
    assert got.count() == odd.count() and got.where("score != 0.5").count() == 0
    assert rule_ensemble.paths("Tree 0\n  If (feature 0 <= 1.5)\n   Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0", ("a",)) == [
        (("a", "<=", 1.5),),
        (("a", ">", 1.5),),
    ]


def test_token_counts_stay_right_when_the_machine_forgets(monkeypatch):
    spec = token_counts.read_spec(public_tokenizers.path(queries.WORD_BPE))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, 12))) for _ in range(600)]
    whole = token_counts.Merger([tuple(m) for m in spec["merges"]], spec["end"])
    want = [whole.count(w) for w in words]
    monkeypatch.setattr(token_counts, "COMPILED", 300)
    whole.forget()
    held = 0
    for word, n in zip(words, want, strict=True):
        assert whole.count(word) == n
        held = max(held, len(whole.states))
    # At most one word's states and answers beyond the bound.
    assert held < 300 + 100


def test_the_sample_of_labels_goes_to_the_texts(docs, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    plan = rule_ensemble.sampled(docs, labels, "doc_id", "text", 100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_token_counts_equal_the_library(docs, odd):
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    machine = token_counts.Counter(token_counts.read_spec(public_tokenizers.path(queries.WORD_BPE)))
    rng = random.Random(1)
    letters = "abcdefgh ''''srtvelmd Σééİﬁ 中文\U0001f600 12½!?.\n\t_\x00ABC"
    texts = ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(600)]
    texts += ["it's we're ''s !'s 'really <|endoftext|>x <|startoftext|>", "", LONG]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert machine.counts(texts).tolist() == want
    got = token_counts.token_counts(docs, public_tokenizers.path(queries.WORD_BPE)).join(docs, "doc_id").limit(60).collect()
    for r in got:
        assert r.n_tokens == len(library.encode(r.text, add_special_tokens=False).ids) and r.n_bytes == len(r.text.encode())
    assert token_counts.token_counts(odd, public_tokenizers.path(queries.WORD_BPE)).where("n_tokens = 0").count() == 3


def test_splitter_is_the_same_from_any_chunk():
    rng = random.Random(2)
    import numpy as np

    after, begins = token_counts.splitter()
    classes = np.array(rng.choices(range(4), k=5000), np.uint8)
    state, want = token_counts.BETWEEN, []
    for c in classes:
        want.append(bool(begins[state, c]))
        state = after[state, c]
    assert token_counts.word_starts(classes, after, begins).tolist() == want


def test_licenses_equal_containment(spark, docs, odd):
    texts = [f"some words before. {t} And some after it." for t in licenses.TEMPLATES.values()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.licenses.split(",") for r in licenses.license_matches(frame).collect()}
    for i, name in enumerate(licenses.TEMPLATES):
        assert name in got[i]

    def brute(text):
        words = decontam.words_of(text.encode())
        for name, template in sorted(licenses.TEMPLATES.items()):
            t = decontam.words_of(template.encode())
            want = {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))}
            have = {tuple(words[k : k + len(min(want, key=len))]) for k in range(len(words))}
            if len(want & have) >= 0.8 * len(want):
                yield name

    for r in licenses.license_matches(docs).join(docs, "doc_id").collect():
        assert r.licenses == ",".join(brute(r.text))
    assert licenses.license_matches(odd).where("n_licenses > 0").count() == 0


def test_licenses_are_told_apart(spark):
    templates = licenses.read_templates()
    known = licenses.Templates(templates)

    def found(text):
        return known.matches(decontam.words_of(text.encode()), licenses.WordHashes())

    header = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    want = {
        "This code is licensed under the MIT License": "MIT",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "licensed under the GNU General Public License, version 2": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        header.format("program", "Affero General Public License", "3"): "AGPL-3.0",
        header.format("library", "Lesser General Public License", "3"): "LGPL-3.0",
        header.format("program", "General Public License", "2"): "GPL-2.0",
        header.format("program", "General Public License", "3"): "GPL-3.0",
        "Released under the terms of the Eclipse Public License 2.0.": "EPL-2.0",
        "SPDX-License-Identifier: 0BSD": "0BSD",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    }
    for spdx in ("BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MIT", "ISC", "0BSD"):
        want[templates[f"{spdx}#text"]] = spdx
    got = {text: found(f"Some words before. {text} And some after it.") for text in want}
    assert {t: sorted({m["license"] for m in ms}) for t, ms in got.items()} == {t: [name] for t, name in want.items()}
    places = [(m["license"], m["first_word"], m["last_word"]) for m in found("under the MIT License or under the ISC license or under the MIT License")]
    assert places == [("ISC", 5, 8), ("MIT", 0, 3), ("MIT", 10, 13)]
    assert found("GNU General Public License, version 7, and nothing else") == []
    frame = spark.createDataFrame([(1, "x under the MIT License"), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in licenses.license_matches(frame, templates=templates).collect()}
    assert rows[1].licenses == "MIT" and rows[1].matches[0].last_word == 4 and rows[2].matches == []


def test_one_row_of_each_group_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, a), (1, a + " more"), (2, a), (None, a), (None, b), (None, b), (None, b + " more"), (3, ""), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dups.deduplicated(frame).collect()
    assert sorted((r.doc_id or 0, r.text[:1]) for r in got) == [(0, "b"), (1, "a"), (3, ""), (4, "")]


@pytest.fixture(scope="module")
def ranks():
    lines = open(public_tokenizers.path(queries.BYTE_BPE)).read().split("\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def test_bpe_equals_the_library(spark, docs, odd, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(4)
    letters = "abcdeilnorst ’'éü中文\U0001f600 0123\n\t<|endoftext|>"
    for text in ["".join(rng.choices(letters, k=rng.randrange(120))) for _ in range(300)] + [LONG, "a" * 3000]:
        ids = library.encode_ordinary(text)
        assert encoder.encode(text) == ids and encoder.decode(ids) == text.encode()
    path = public_tokenizers.path(queries.BYTE_BPE)
    rows = bpe.encoded(docs, path, public_tokenizers.PATTERN).limit(50).collect()
    assert all(r.bpe.ids == library.encode_ordinary(r.text) and bytes(r.bpe.decoded) == r.text.encode() for r in rows)
    assert bpe.digests(odd, path, public_tokenizers.PATTERN).where("n_tokens = 0").count() == 2


def test_pieces_that_begin_alike_share_the_prefix_table(ranks, monkeypatch):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    append, computed = bpe.PrefixTable.append, []
    monkeypatch.setattr(bpe.PrefixTable, "append", lambda table, more: (computed.append(len(more)), append(table, more)))
    monkeypatch.setattr(bpe, "LONG_PIECE", 200)
    rng = random.Random(8)
    ends = ["".join(rng.choices("abcdeinorst", k=4)) for _ in range(300)]
    texts = ["", *(f" nearlyalikebeginning{end} {'ab' * k}" for k, end in enumerate(ends)), "", "é" * 500]
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for _ in range(2):  # then all pieces are known
        assert list(encoder.encode_all(texts)) == [library.encode_ordinary(text) for text in texts]
    words = sum(len(text.split()[0]) + 1 for text in texts[1:-2])
    longer = sum(2 * k + 1 for k in range(100, 300)) + 1000  # pieces of more than 200 bytes are computed for themselves
    assert sum(computed) < longer + words / 2


def test_appends_and_edits_are_exact(ranks):
    vocabulary = bpe.Vocabulary(ranks)
    rng = random.Random(5)
    for _ in range(40):
        data = bytes(rng.choices(b"abcdeinorst ", k=rng.randrange(1, 300)))
        grown = bpe.PrefixTable(vocabulary)
        for k in range(0, len(data), 7):
            grown.append(data[k : k + 7])
        assert grown.tokens() == bpe.merge_bytes(data, ranks)
        start = rng.randrange(len(data) + 1)
        end = min(len(data), start + rng.randrange(5))
        new = bytes(rng.choices(b"abcdeinorst ", k=rng.randrange(4)))
        grown.edit(start, end, new)
        assert bytes(grown.data) == data[:start] + new + data[end:]
        assert grown.tokens() == bpe.merge_bytes(bytes(grown.data), ranks)


def test_pipeline_by_hand(spark, ranks):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = queries.near_dups.written(stage(spark, docs, D))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 1:
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {i for i, _, _, kept in brute_components(rows, 5, 80) if kept}
        if k == 3:
            assert docs.count() == before.count()
    assert docs.where("not round_trip").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, D).collect()) == sorted(r.doc_id for r in docs.collect())
