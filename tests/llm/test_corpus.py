"""Corpus operators against brute force on small texts, and their defined results on odd input."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import catalog, decontamination, heavy, jaccard_join, line_dedup, lm_scoring, packing, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, token_counts, warc
from sparkloom.llm import textarrays as ta
from sparkloom.llm.components import components
from sparkloom.llm.token_counts import tokenizer_path

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _id long, rows string, ids string, spans string, n_words long, a int, b int, _key long"


def frame(spark, texts, start=0):
    """Documents with repeats of names that operators use inside."""
    data = [(None if t == "<null id>" else start + i, t, None, None if i % 5 == 0 else f"s{i % 3}", None, "k", 1, "r", "i", "s", 2, 3, 4, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA)


def odd_texts():
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(1, 6)))
    base = [" ".join(word() for _ in range(120)) + "." for _ in range(4)]
    near = [" ".join(w if random.random() > 0.03 else "zz" for w in base[0].split()) for _ in range(12)]
    sentences = lambda n: " ".join(" ".join(word() for _ in range(8)).capitalize() + "." for _ in range(n))
    passage = sentences(9)
    inside = [f"{sentences(3)} {word()} {passage} {word()} {sentences(2)}" for _ in range(4)]
    odd = [None, "", " ", "\n\n", "one", "two words", "é ü 日本語 🙂", "<null id>", base[1], base[1], base[2] + "\n" + base[2], "x" * 3000, "ab " * 900, sentences(400)]
    return [*base, *near, *inside, *odd]


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall(text or "")


def test_quality_rules(docs, texts, empty):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality_rules.assess(docs).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[None if t == "<null id>" else i, len(w), sum(map(len, w))]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.assess(empty).count() == 0
    kept = quality_rules.clean(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got.values())


def test_lines_that_many_documents_of_a_host_share_are_removed(spark):
    body = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(40)]
    texts = [f"{b}\nShared line here" if i < 30 else b for i, b in enumerate(body)] + ["Shared line here\nshared LINE  here\n" + " ".join(f"y{k}" for k in range(19))]
    data = [(i, t, "h") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.assess(df, min_words_left=20).collect()}
    assert [got[0].n_words, got[0].n_words_left, got[0].kept] == [33, 30, True]
    assert [got[40].n_words_left, got[40].base_failed, got[40].kept] == [19, False, False]
    assert {r.doc_id: r.text for r in quality_rules.clean(df, min_words_left=20).collect()} == {i: body[i] for i in range(40)}


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def components_of(sets):
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in ids}


def test_jaccard_join(docs, texts, empty):
    sets = {i: shingles(t) for i, t in enumerate(texts) if t != "<null id>"}
    want = components_of(sets)
    got = jaccard_join.near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i in sets} | {(None, 1, None)}
    assert len(got) == len(texts)
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert {r.doc_id for r in jaccard_join.one_of_each(docs).collect()} == set(want.values()) | {None}


@pytest.mark.parametrize("rare", [1, 4])
def test_jaccard_join_of_chains_of_edits(spark, monkeypatch, rare):
    """Near copies of near copies, most tokens frequent, so that components need links between leaves."""
    monkeypatch.setattr(jaccard_join, "RARE_DOCS", rare)
    random.seed(rare)
    found = [[f"w{random.randint(0, 10**6)}" for _ in range(n)] for n in (7, 20, 60, 60)]
    for _ in range(60):
        parent = list(random.choice(found))
        for _ in range(random.choice((1, 2, 3))):
            parent[random.randrange(len(parent))] = f"w{random.randint(0, 10**6)}"
        found.append(parent)
    texts = [" ".join(x) for x in found]
    want = components_of({i: shingles(t) for i, t in enumerate(texts)})
    got = jaccard_join.near_duplicates(frame(spark, texts))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (7, 7), (None, 3), (100, 50)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 100: 50}
    assert components(edges.limit(0)).count() == 0


def brute_repeats(texts, length=200):
    counts = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("gathered", [1, 512])
def test_suffix_dedup(spark, docs, texts, empty, gathered):
    extra = ["a" * 900, "ab" * 300 + "c", "é" * 150, texts[0][50:400] + texts[1][:300], texts[1][10:330] + texts[0][60:380]]
    more = docs.unionByName(frame(spark, extra, 1000)).unionByName(frame(spark, [texts[0]], 0))
    every = [(None if t == "<null id>" else i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(extra)] + [(0, texts[0])]
    want = sorted((str(i), *b) for (i, _), b in zip(every, brute_repeats([(t or "").encode() for _, t in every]), strict=True))
    got = suffix_dedup.remove_repeats(more, gathered=gathered).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize(("copies", "gathered"), [(1200, 16), (1200, 512), (300, 1)])
def test_suffix_dedup_of_a_large_group_of_near_copies(spark, copies, gathered):
    """Thousands of different segments of each anchor: slices down to single windows, with few rows between tasks."""
    random.seed(copies)
    base = "".join(random.choice("abcdefghij klmnopqrst") for _ in range(420))
    texts = []
    for _ in range(copies):
        t = list(base)
        for _ in range(random.choice((0, 1, 1, 2, 3))):
            t[random.randrange(len(t))] = random.choice("0123456789")
        texts.append("".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    want = {i: b for i, b in enumerate(brute_repeats([t.encode() for t in texts]))}
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(df, gathered=gathered).collect()}
    assert got == want


def test_slices_bound_what_is_sorted_together():
    kinds = np.array([1, 512, 513, 5000, 10**6, 10**9])
    parts = suffix_dedup.slices(kinds, 512, 137)
    assert parts.tolist() == [1, 1, 4, 32, 137, 137]


def test_shards_in_few_partitions_are_worked_on_one_at_a_time(spark):
    rows = spark.createDataFrame([(k % 50, bytes([k % 50])) for k in range(400)], "shard int, x binary").repartition(5)

    def run(batches):
        found = [x for b in batches for x in b.column(1).to_pylist()]
        assert len(set(found)) == 1
        yield pa.RecordBatch.from_arrays([pa.array([found[0][0]], pa.int32()), pa.array([len(found)], pa.int64())], names=["shard", "n"])

    for most in (7, 100):
        got = packing.by_shard(rows, 50, run, "shard int, n long", most).collect()
        assert sorted((r.shard, r.n) for r in got) == [(k, 8) for k in range(50)]


def test_suffix_order():
    data = np.frombuffer(b"banana" * 40 + b"bandana" * 40 + b"x" * 64, np.uint8)
    starts = np.arange(0, 400)
    order, _ = suffix_dedup.sorted_suffixes(data, suffix_dedup.ta.Prefixes(data), starts, starts % 3, 64)
    texts = [(int(s) % 3, data[s : s + 64].tobytes()) for s in order]
    assert texts == sorted(texts)


def brute_runs(t, found, least, line):
    """(first word, last word) of every unit of a text whose words stand at the places found, from a plain reading of the definition."""
    gap = lambda k: t[found[k][0] : found[k + 1][0] if k + 1 < len(found) else len(t)]
    ends = [k for k in range(len(found)) if re.search(r"[.!?\n]", gap(k)) or k + 1 == len(found)]
    starts = [0, *[e + 1 for e in ends[:-1]]] if ends else []
    pairs = set()
    for s in starts:
        e = next((e for e in ends if e + 1 - s >= least), None)
        if e is not None:
            pairs.add((s, e))
    for e in ends:
        s = next((s for s in reversed(starts) if s <= e and e + 1 - s >= least), None)
        if s is not None:
            pairs.add((s, e))
    lines = [k for k in range(len(found)) if "\n" in gap(k) or k + 1 == len(found)]
    pairs |= {(s, e) for s, e in zip([0, *[e + 1 for e in lines[:-1]]], lines, strict=False) if e + 1 - s >= line}
    return sorted(pairs)


def brute_units(texts, least=line_dedup.UNIT_WORDS, line=line_dedup.LINE_WORDS):
    """Places of every unit of each text, by its words."""
    for t in texts:
        found = [(m.start(), m.end()) for m in WORD.finditer(t)]
        yield [(found[s][0], found[e][1], tuple(t[a:b].translate(LOWER) for a, b in found[s : e + 1])) for s, e in brute_runs(t, found, least, line)]


def test_line_dedup(docs, texts, empty):
    ascii_only = [(i, t) for i, t in enumerate(texts) if t and t.isascii() and t != "<null id>"]
    first, removed = {}, {}
    for (i, _), units in zip(ascii_only, brute_units([t for _, t in ascii_only]), strict=True):
        for a, b, unit in units:
            if unit in first and first[unit] != (i, a):
                removed.setdefault(i, set()).update(range(a, b))
            first.setdefault(unit, (i, a))
    got = {r.doc_id: r for r in line_dedup.remove_repeated_units(docs).collect()}
    for i, t in ascii_only:
        gone = {k for s in got[i].spans for k in range(s.start, s.stop) if not t[k].isspace()}
        assert gone == {k for k in removed.get(i, ()) if not t[k].isspace()}
        kept = "".join(c for k, c in enumerate(t) if not any(s.start <= k < s.stop for s in got[i].spans))
        assert got[i].kept_text == kept
    assert any(removed.values())
    assert got[texts.index(None)].kept_text is None
    assert got[texts.index("")].kept_text == ""
    assert line_dedup.remove_repeated_units(empty).count() == 0


def test_short_lines_that_repeat_are_removed_with_their_offsets(spark):
    texts = [f"Own {i}\nShared line\n\n  SHARED   short two\nown again {i}" for i in range(5)]
    got = line_dedup.remove_repeated_units(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)).orderBy("doc_id").collect()
    assert got[0].kept_text == texts[0] and got[0].spans == []
    for i in range(1, 5):
        assert got[i].kept_text == f"Own {i}\nown again {i}"
        assert "".join(texts[i][a:b] for a, b in got[i].spans).split() == "Shared line SHARED short two".split()
    with pytest.raises(TypeError, match="whole numbers"):
        line_dedup.remove_repeated_units(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_passages_are_removed_wherever_sentences_end(spark):
    random.seed(5)
    name = lambda n: [f"w{random.randint(0, 10**9)}" for _ in range(n)]
    shared, short, long = name(50), name(49), name(83)
    lists = [name(9) + shared + name(7) + short, name(30) + shared + name(30), name(4) + short + name(60), name(3) + long + ["x."] + name(70), long[:20] + long, ["ab"] * 300, name(51)]
    texts = [" ".join(w) for w in lists] + ["\u3002 ".join(" ".join(long[k : k + 7]) for k in range(0, 77, 7)), ""]
    seen, want = {}, []
    for i, t in enumerate(texts):
        w = t.split()
        gone = set()
        for k in range(len(w) - 49):
            d, at = seen.setdefault(tuple(w[k : k + 50]), (i, k))
            gone |= set(range(max(k, at + 50) if d == i else k, k + 50)) if (d, at) != (i, k) else set()
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 4):
        got = corpus_pipeline.repeated_passages(spark, df.repartition(parts, "doc_id"), SMALL).collect()
        assert sorted((r.doc_id, r.text) for r in got) == want
    assert len(want[1][1].split()) == 60 and len(want[2][1].split()) == 113 and len(want[4][1].split()) == 20 and len(want[5][1].split()) == 50


def test_decontamination(spark, docs, texts, empty):
    item = " ".join(f"q{k}" for k in range(20))
    changed = " ".join(f"q{k}" if k % 5 else "other" for k in range(20))
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, " ".join(f"p{k}" for k in range(40)))], "item_id long, text string")
    extra = frame(spark, [f"Before it. {item.upper()}! After", f"start {changed} end", " ".join(f"q{k}" for k in range(5)), item, "and " + " ".join(f"p{k}" for k in range(10, 27))], 2000)
    got = {r.doc_id: r for r in decontamination.assess(docs.unionByName(extra), bench).collect()}
    assert [got[2000 + k].contaminated for k in range(5)] == [True, True, False, True, True]
    assert got[2000]["items"] == [1] and got[2000].best_share == 1.0 and round(got[2001].best_share, 2) == 0.8
    assert not any(r.contaminated for i, r in got.items() if i is None or i < 2000)
    assert decontamination.clean(docs.unionByName(extra), bench).count() == len(texts) + 1
    assert decontamination.assess(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.assess(docs, bench.limit(0)).collect())


def brute_items(tokens, items):
    """Numbers of the items of which a stretch of 24 words, or the whole, matches in place: all placements tried one by one."""
    found = []
    for j, w in enumerate(items):
        n = min(len(w), 24)
        best = 0
        for s in range(-len(w), len(tokens)) if len(w) >= 8 else ():
            flags = [0 <= s + k < len(tokens) and tokens[s + k] == x for k, x in enumerate(w)]
            if sum(flags) >= 8:
                best = max(best, *(sum(flags[k : k + n]) for k in range(len(w) - n + 1)))
        if best >= 8 and 10 * best >= 6 * n:
            found.append(j)
    return found


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontamination_finds_every_placement_of_the_rule(spark, monkeypatch, most):
    """Random substitutions around the least that counts, against all placements, with seeds broadcast and shuffled."""
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", most)
    random.seed(8)
    common = [f"c{k}" for k in range(40)]
    lists = [[random.choice(common) for _ in range(n)] for n in (7, 8, 9, 13, 15, 15, 16, 20, 20, 26, 27, 31, 39, 45, 59, 80, 120)] + [["c1"] * 60]
    texts = []
    for w in lists[:-1] * 25:
        n = min(len(w), 24)
        at = random.randint(0, len(w) - n)
        need = max(8, -(-6 * n // 10)) - random.choice((0, 0, 0, 1))
        kept = set(random.sample(range(at, at + n), max(0, min(n, need))))
        texts.append([f"x{random.randint(0, 9)}" for _ in range(random.randint(0, 5))] + [x if k in kept else f"y{k}" for k, x in enumerate(w)] + ["z"] * random.randint(0, 3))
    texts += [[x if k % 5 in (0, 1, 3) else "other" for k, x in enumerate(w)] for w in lists] + [["c1"] * n for n in (7, 14, 15, 300)]
    want = {i: brute_items(t, lists) for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(lists)], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontamination.assess(df, bench).collect()} == want
    assert 200 < sum(map(bool, want.values())) < len(texts)


def test_decontamination_leaves_unrelated_long_texts_alone(spark):
    random.seed(9)
    names = [f"v{k}" for k in range(300)]
    text = lambda n: " ".join(random.choice(names) for _ in range(n))
    df = spark.createDataFrame([(i, text(1500)) for i in range(200)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(j, text(800)) for j in range(5)], "item_id long, text string")
    assert decontamination.assess(df, bench).where("contaminated").count() == 0


def test_decontamination_judges_items_by_row(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(12)) for c in "abc")
    bench = spark.createDataFrame([(1, one), (1, two), (None, three), (None, three), (5, None)], "item_id long, text string")
    df = spark.createDataFrame([(1, one), (1, two), (1, two), (2, f"x {three} y"), (None, three), (3, f"{one} {two} {three}"), (4, None), (5, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.contaminated, r.n_items, r["items"]) for r in decontamination.assess(df, bench).collect())
    assert got == [("1", True, 1, [1])] * 3 + [("2", True, 1, []), ("3", True, 3, [1]), ("4", False, 0, []), ("5", False, 0, []), ("None", True, 1, [])]
    assert [r.doc_id for r in decontamination.clean(df, bench).orderBy("doc_id").collect()] == [4, 5]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_token_counts(docs, texts, empty, name):
    if name.endswith(".json"):
        count = lambda t: len(Tokenizer.from_file(str(tokenizer_path(name))).encode(t, add_special_tokens=False).ids)
    elif name.endswith(".model"):
        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=str(tokenizer_path(name))).encode(t))
    else:
        count = lambda t: len(Tokenizer.from_file(str(tokenizer_path("byte_bpe_50k.json"))).encode(t, add_special_tokens=False).ids)
    want = sorted((str(None if t == "<null id>" else i), len((t or "").encode()), count(t or "")) for i, t in enumerate(texts))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, name).collect()) == want
    assert token_counts.count_tokens(empty, name).count() == 0


def test_long_texts_are_cut_where_it_makes_no_difference():
    text = "It's <|endoftext|> 42 words'll  go\n\n on, and on. " * 400
    whole = Tokenizer.from_file(str(tokenizer_path("byte_bpe_50k.json"))).encode(text, add_special_tokens=False).ids
    parts = list(token_counts.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    assert token_counts.lengths([text], token_counts.counter("byte_bpe_50k.json")[0], True) == [len(whole)]


def test_texts_without_ascii_are_cut_and_other_tokenizers_get_whole_texts():
    text = "日本語の文章です。次は1つ、「短い」文です！한국어 문장（예）입니다" * 300
    whole = Tokenizer.from_file(str(tokenizer_path("byte_bpe_50k.json"))).encode(text, add_special_tokens=False).ids
    parts = list(token_counts.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 50 and max(map(len, parts)) < 200
    count, split = token_counts.counter("byte_bpe_50k.json")
    assert split and sum(count(parts)) == len(whole)
    assert not token_counts.counter("word_bpe_49k.json")[1] and not token_counts.counter("piece_bpe_32k.model")[1] and token_counts.counter("byte_bpe_50k.tiktoken")[1]


def test_sentencepiece(docs, texts, empty):
    known = sentencepiece.SentencePieceProcessor(model_file=str(tokenizer_path("piece_bpe_32k.model")))
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()
    for r in coded:
        assert r["ids"] == (None if r.text is None else known.encode(r.text))
        assert r.decoded == r.text
    assert len(coded) == len(texts)
    assert sentencepiece_codec.encode(empty).count() == 0
    own = sentencepiece_codec.model("piece_bpe_32k.model")
    random.seed(3)
    for _ in range(200):
        t = "".join(random.choice("abc déß▁ \t\n.,<0xA>日🙂") for _ in range(random.randint(0, 150)))
        assert own.encode(t) == known.encode(t)
        assert own.decode(known.encode(t)) == known.decode(known.encode(t))


def test_streaming_gives_final_ids_early():
    own = sentencepiece_codec.model("piece_bpe_32k.model")
    parts = list(own.stream("x" * 40 + "international" * 30))
    assert len(parts) > 10 and "".join(own._text(x) for part in parts for x in part) == "x" * 40 + "international" * 30
    assert [own._text(x) for part in parts for x in part] == list(own.merged("x" * 40 + "international" * 30))


def test_all_text_is_encoded_by_streaming(monkeypatch):
    """Every part that is not remembered goes through stream(), and nothing is remembered that did not."""
    own = sentencepiece_codec.Model(open(tokenizer_path("piece_bpe_32k.model"), "rb").read())
    seen, real = [], own.stream
    monkeypatch.setattr(own, "stream", lambda text: seen.append(text) or real(text))
    known = sentencepiece.SentencePieceProcessor(model_file=str(tokenizer_path("piece_bpe_32k.model")))
    for t in (*(x for x in odd_texts() if x), "Unbroken" * 400, "日本語テキスト。" * 300):
        assert own.encode(t) == known.encode(t)
        assert all(part in seen for part in own._split.findall(own.normalised(t)))
    assert set(own._words) <= set(seen)


def test_unigram_trellis():
    """A hand-made unigram model: the greatest sum of scores wins, as brute force finds it."""

    def field(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    import struct

    pieces = {"<unk>": (0.0, 2), "▁": (-3.0, 1), "a": (-2.0, 1), "b": (-2.5, 1), "ab": (-3.0, 1), "aba": (-3.5, 1), "▁a": (-2.2, 1), "bab": (-6.5, 1)}
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for p, (s, k) in pieces.items())
    own = sentencepiece_codec.Model(data + field(2, b"\x18\x01"))

    def best(text):
        if not text:
            return 0.0, []
        ways = []
        for p, (s, k) in pieces.items():
            if k == 1 and text.startswith(p):
                rest = best(text[len(p) :])
                ways.append((s + rest[0], [p, *rest[1]]))
        return max(ways, key=lambda x: x[0])

    for t in ("abab", "ababab", "a b ab", "bababab"):
        want = best(own.normalised(t))
        got = [own._text(x) for part in own.stream(own.normalised(t)) for x in part]
        assert sum(pieces[p][0] for p in got) == pytest.approx(want[0])


def brute_losses(data, target):
    """(target's, background's) loss a token of every row, each without the row's own counts."""
    lower = [(i, (t or "").translate(LOWER)) for i, t in data]
    pairs = [Counter(zip(["<s>", *words(t)], words(t), strict=False)) for _, t in lower]
    totals = [sum((p for p, (i, _) in zip(pairs, lower, strict=True) if of is None or i in of), Counter()) for of in (target, None)]
    firsts = []
    for total in totals:
        before = Counter()
        for (a, _), k in total.items():
            before[a] += k
        firsts.append(before)
    for (i, _), own in zip(lower, pairs, strict=True):
        mine = Counter()
        for (a, _), k in own.items():
            mine[a] += k
        n, out = sum(own.values()), []
        for total, before, off in zip(totals, firsts, (i in target, True), strict=True):
            loss = -sum(k * np.log((total[x] - off * k + lm_scoring.ALPHA) / (before[x[0]] - off * mine[x[0]] + lm_scoring.ALPHA * lm_scoring.VOCABULARY)) for x, k in own.items())
            out.append(loss / n if n else None)
        yield tuple(out)


def close(row, loss):
    return (row.loss_target is None and loss[0] is None) or (row.loss_target == pytest.approx(loss[0], abs=3e-5) and row.loss_background == pytest.approx(loss[1], abs=3e-5))


@pytest.mark.parametrize("heavy_docs", [1, 2048])
def test_lm_scoring_of_every_row(spark, docs, texts, monkeypatch, heavy_docs):
    """Rows repeated, without ids and without texts, with heavy values and without: all against brute force."""
    monkeypatch.setattr(heavy, "LEAST_DOCS", heavy_docs)
    data = [(None if t == "<null id>" else i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (3, texts[2]), (None, "<null id>"), (None, "one")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(k,) for k in (0, 3, 7, 9, 77)], "doc_id long")
    got = lm_scoring.cross_entropy_difference(df, target).collect()
    want = list(brute_losses(data, {0, 3, 7, 9, 77}))
    key = lambda i, n, loss: (str(i), n, loss is not None, round(loss or 0, 3))
    left = sorted(zip((key(i, len(words(t)), loss[0]) for (i, t), loss in zip(data, want, strict=True)), want, strict=True), key=lambda x: x[0])
    right = sorted(((key(r.doc_id, r.n_tokens, r.loss_target), r) for r in got), key=lambda x: x[0])
    assert len(left) == len(right) == len(data)
    assert all(a[:2] == b[:2] and close(r, loss) for (a, loss), (b, r) in zip(left, right, strict=True))


def test_lm_scoring_of_many_rows_without_words(spark):
    data = [(i, "") for i in range(70_000)] + [(70_001, "aa bb aa"), (70_002, "aa bb cc")]
    got = lm_scoring.cross_entropy_difference(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), spark.createDataFrame([(70_001,)], "doc_id long"))
    some = {r.doc_id: r for r in got.where("n_tokens > 0").collect()}
    want = dict(zip((70_001, 70_002), list(brute_losses(data[-2:], {70_001})), strict=True))
    assert set(some) == set(want) and all(close(some[i], want[i]) for i in want) and got.count() == 70_002


@pytest.mark.parametrize("share", [1, 10**9])
def test_heavy_values_are_bounded_and_found(spark, monkeypatch, share):
    monkeypatch.setattr(heavy, "LEAST_DOCS", 8)
    texts = [f"all half{k % 2} w{k}" for k in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    monkeypatch.setattr(heavy, "MOST", 4 if share == 1 else 1 << 18)
    found = heavy.heavy_values(df, 0, lambda part: ta.word_hashes(*ta.buffer_of(part.column(0)))[0])
    named = dict(zip(ta.word_hashes(*ta.buffer_of(pa.array(["all half0 half1"])))[0].tolist(), ("all", "half0", "half1"), strict=True))
    assert {named.get(x) for x in found.tolist()} == ({"all"} if share == 1 else {"all", "half0", "half1"})


def test_lm_scoring(spark, docs, texts, empty):
    random.seed(2)
    topic = lambda names, n: " ".join(random.choice(names) for _ in range(n))
    fruit, metal = [f"fruit{k}" for k in range(12)], [f"metal{k}" for k in range(12)]
    data = [(k, topic(fruit if k % 2 else metal, 60)) for k in range(200)] + [(None, "fruit1 fruit2"), (500, None), (501, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    target = spark.createDataFrame([(k,) for k in range(1, 120, 2)] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(df, target).collect()}
    assert len(got) == 203 and got[500].score is None and got[501].n_tokens == 0
    assert max(got[k].score for k in range(121, 200, 2)) < min(got[k].score for k in range(120, 200, 2))
    want = brute_losses(data, set(range(1, 120, 2)))
    for (i, _), loss in zip(data, want, strict=True):
        assert close(got[i], loss)
    assert lm_scoring.cross_entropy_difference(empty, target).count() == 0
    assert lm_scoring.cross_entropy_difference(docs, target.limit(0)).count() == len(texts)


def test_lm_scoring_counts_long_texts_in_full(spark):
    """A word more often in one text than a packed count holds: losses as counted in whole numbers, of that text and of another."""
    n = 140_000
    data = [(1, "aa " * n), (2, "aa aa bb " * 40), (3, "aa bb " * 3 + "aa " * 70_000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    target = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(df, target).collect()}
    pairs = {i: Counter(zip(["<s>", *t.split()], t.split(), strict=False)) for i, t in data}
    for i, t in data:
        for name, of in (("loss_target", {1, 2}), ("loss_background", {1, 2, 3})):
            others = sum((pairs[j] for j in of - {i}), Counter())
            before = Counter()
            for (a, _), k in others.items():
                before[a] += k
            loss = -sum(k * np.log((others[x] + lm_scoring.ALPHA) / (before[x[0]] + lm_scoring.ALPHA * lm_scoring.VOCABULARY)) for x, k in pairs[i].items())
            assert getattr(got[i], name) == pytest.approx(loss / len(t.split()), abs=2e-5)
    assert got[1].n_tokens == n


def test_quality_classifier(spark, docs, texts, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = quality_classifier.train(known, labels)
    assert rules == quality_classifier.train(known.repartition(5), labels)
    got = quality_classifier.predict(known, rules).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got) > 50
    odd = quality_classifier.predict(docs, rules).collect()
    assert len(odd) == len(texts) and all(0 <= r.score <= 1 for r in odd)
    none = quality_classifier.train(known, labels.limit(0))
    assert none.rules == () and quality_classifier.predict(empty, none).count() == 0


@pytest.mark.parametrize("hot", [1, 4096])
def test_warc(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    html = ["<p>é</p>" * 30, "<p>é</p>" * 30, None, "", "short", "short", "<p>é</p>" * 30, "x" * 99, "x" * 99, "y" * 100, "y" * 100]
    pages = spark.createDataFrame([(10 + i, None if i == 4 else f"http://h/{i}\r\nX: y", h, "z") for i, h in enumerate(html)] + [(None, "u", "y" * 100, "z"), (10, "again", html[0], "z")], "page_id long, url string, html string, file string").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, f"file://{tmp_path}").collect())
    want = []
    for i, h in [*((10 + i, h) for i, h in enumerate(html)), (None, "y" * 100), (10, html[0])]:
        data = (h or "").encode()
        first = min(10 + k for k, x in enumerate(html) if (x or "") == (h or "")) if len(data) >= 100 else i
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(want)
    every = [r for p in tmp_path.glob("*.warc.gz") for r in warc.records_of(p.read_bytes())]
    assert len(every) == len(want)
    index = warc.write(pages, f"file://{tmp_path}/two")
    back = warc.read(index.where("record_type = 'response' AND page_id > 15")).collect()
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in back) and back
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/three").count() == 0
    place = index.where("page_id = 19").first()
    file = Path(place.file.removeprefix("file://"))
    data = bytearray(file.read_bytes())
    data[place.offset + place.length // 2] ^= 255
    file.write_bytes(data)
    found = {(r.page_id, r.url if r.record_type == "damaged" else r.record_type) for r in warc.read(index.where("page_id IN (18, 19)"), damaged="report").collect()}
    assert found == {(18, "response"), (None, f"{place.file}:{place.offset}")}
    with pytest.raises(Exception, match="damaged|decompress"):
        warc.read(index.where("page_id = 19")).collect()


def test_ranges_are_coalesced():
    near, far = [("f", 0, 10), ("f", 10, 10), ("f", 100, 5)], [("f", warc.GAP_BYTES + 200, 5), ("g", 0, 1)]
    assert [(r[0], r[1], r[2], sorted(r[3])) for r in warc.ranges([*far, *near])] == [("f", 0, 105, [2, 3, 4]), ("f", warc.GAP_BYTES + 200, warc.GAP_BYTES + 205, [0]), ("g", 0, 1, [1])]


def test_pipeline_stages(spark, texts, docs):
    bench = f"{SMALL}"
    kept = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL")
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, bench).cache()
        if name != "sentencepiece":
            assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars is None or r.n_chars == len(r.text) or name in ("ngram_jaccard_join", "benchmark_decontamination") for r in kept.collect())
    left = kept.collect()
    assert {r.doc_id for r in left} <= set(range(len(texts))) and all(r.round_trip for r in left)
    assert 0 in {r.doc_id for r in left} and not {1, 2, 3} - {r.doc_id for r in left}


def brute_cleaned(rows):
    """What the quality rules keep of (id, text, host) rows: id to text without frequent lines."""
    same = lambda x: "".join(words(x)).lower()
    lines = {i: [x for x in (t or "").split("\n") if words(x)] for i, t, _ in rows}
    hosts, seen = Counter(h or "" for _, _, h in rows), Counter((h or "", x) for i, _, h in rows for x in {same(y) for y in lines[i]})
    out = {}
    for i, t, h in rows:
        gone = {x for x in map(same, lines[i]) if seen[h or "", x] > 10 and seen[h or "", x] > 0.1 * hosts[h or ""]}
        w = words(t)
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        left = len(w) - sum(len(words(x)) for x in lines[i] if same(x) in gone)
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and left >= 10 and left >= 0.3 * len(w):
            out[i] = "\n".join(x for x in t.split("\n") if same(x) not in gone) if gone else t
    return out


def brute_kept_words(texts, least, line, length):
    """id to the words that stay of texts in the order of their ids: units and runs of `length` words that occur earlier go."""
    seen, runs, out = {}, {}, {}
    for i, t in sorted(texts.items()):
        found = [(m.start(), m.end()) for m in WORD.finditer(t)]
        w = [t[a:b].translate(LOWER) for a, b in found]
        gone = set()
        for s, e in brute_runs(t, found, least, line):
            if seen.setdefault(tuple(w[s : e + 1]), (i, s)) != (i, s):
                gone |= set(range(s, e + 1))
        for k in range(len(w) - length + 1):
            d, at = runs.setdefault(tuple(w[k : k + length]), (i, k))
            if (d, at) != (i, k):
                gone |= set(range(max(k, at + length) if d == i else k, k + length))
        out[i] = [t[a:b] for k, (a, b) in enumerate(found) if k not in gone]
    return out


def tokens_of(text):
    return [x for x in re.split("[" + re.escape(" \t\n\x0b\x0c\r" + decontamination.PUNCTUATION) + "]", (text or "").lower()) if x]


def brute_leaks(texts, items):
    """Ids of the texts with an overlap: each has two words in a row in place, so only such placements are tried."""
    index = {}
    for j, w in enumerate(items):
        for q in range(len(w) - 1) if len(w) >= 8 else ():
            index.setdefault((w[q], w[q + 1]), []).append((j, q))
    bad = set()
    for i, t in texts.items():
        d = tokens_of(t)
        for j, s in {(j, p - q) for p in range(len(d) - 1) for j, q in index.get((d[p], d[p + 1]), ())}:
            w = items[j]
            n, flags = min(len(w), 24), [0 <= s + k < len(d) and d[s + k] == x for k, x in enumerate(w)]
            if max(sum(flags[k : k + n]) for k in range(len(w) - n + 1)) >= max(8, 0.6 * n):
                bad.add(i)
    return bad


def test_pipeline_against_brute_force(spark):
    """Every stage over all documents against plain Python, each on what the stage before gave."""
    folder = "/root/testdata/sf0.01"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 500").cache()
    texts_of = lambda df: {r.doc_id: r.text for r in df.collect()}
    kept = stages["quality_rules"](spark, docs, folder).cache()
    texts = texts_of(kept)
    assert texts == brute_cleaned([(r.doc_id, r.text, r.source) for r in docs.collect()]) and 100 < len(texts) < docs.count()
    single = stages["ngram_jaccard_join"](spark, kept, folder).cache()
    firsts = set(components_of({i: shingles(t) for i, t in texts.items()}).values())
    assert texts_of(single) == {i: texts[i] for i in firsts} and len(firsts) < len(texts)
    fewer = stages["substring_dedup"](spark, single, folder).cache()
    want = brute_kept_words(texts_of(single), line_dedup.UNIT_WORDS, line_dedup.LONG_LINE_WORDS, line_dedup.PASSAGE_WORDS)
    got = texts_of(fewer)
    assert {i: words(t) for i, t in got.items()} == want and any(len(words(texts[i])) > len(w) for i, w in want.items())
    clean = stages["benchmark_decontamination"](spark, fewer, folder).cache()
    bad = brute_leaks(got, [tokens_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert texts_of(clean) == {i: t for i, t in got.items() if i not in bad} and bad
    known = sentencepiece.SentencePieceProcessor(model_file=str(tokenizer_path("piece_bpe_32k.model")))
    for r in stages["sentencepiece"](spark, clean, folder).collect():
        assert r.ids == known.encode(r.text) and r.n_ids == len(r.ids) and r.round_trip


def test_pipeline_stages_take_empty_tables_and_repeated_rows(spark):
    rows = [(1, "word " * 3 + " ".join(f"a{k}" for k in range(40)), "en", "s", 1)] * 2 + [(2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        left = sorted(r.doc_id for r in stage(spark, docs, SMALL).collect())
        assert left == ([1, 1] if name == "quality_rules" else [1, 1, 2, 3])


def test_texts_longer_than_a_chunk(spark):
    """Texts over the bytes of a chunk, one of them twice, through the operators that work on chunks."""
    random.seed(21)
    long = " ".join(f"w{random.randint(0, 10**8)}" for _ in range(170_000))
    assert len(long) > 1_500_000
    df = spark.createDataFrame([(1, long), (2, long), (3, "x " + long[:1000]), (4, "short")], "doc_id long, text string").repartition(2)
    assert {r.doc_id: len(r.kept_text) for r in line_dedup.remove_repeated_units(df, passage=50).collect()}.items() >= {1: len(long), 2: 0, 4: 5}.items()
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: len(r.kept) for r in suffix_dedup.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 2, 4: 5}
    want = dict(zip((1, 2, 3, 4), brute_losses([(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()], {2}), strict=True))
    assert all(close(r, want[r.doc_id]) for r in lm_scoring.cross_entropy_difference(df, df.where("doc_id = 2")).collect())
    assert {r.doc_id: r.round_trip for r in corpus_pipeline.tokens(spark, df.selectExpr("*", "'en' AS lang", "'s' AS source"), SMALL).collect()} == dict.fromkeys((1, 2, 3, 4), True)


def brute_score(rules, text):
    """A text's probability from the fitted rules, worked out in plain Python."""
    t = text or ""
    w = words(t)
    chars = sum(map(len, t))
    share = lambda a, b: a / b if b > 0 else 0.0
    figures = {
        "n_words": len(w), "word_length": share(chars, len(w)), "distinct_share": share(len(set(w)), len(w)), "upper_share": share(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t), chars),
        "digit_share": share(sum(c in "0123456789" for c in t), chars), "symbol_share": share(sum(c in quality_classifier.SYMBOLS for c in t), chars), "exclaim_share": share(t.count("!"), chars),
        "stop_share": share(t.count("."), len(w)), "line_words": share(len(w), t.count("\n") + 1),
    }
    total = rules.intercept
    for weight, conditions in rules.rules:
        if all(figures[f] <= cut if sign == "<=" else figures[f] > cut for f, sign, cut in conditions):
            total += weight
    return 1 / (1 + np.exp(-total))


def test_quality_scores_against_brute_force(spark, docs, texts):
    """The compiled column expression gives what the rules say, and repeated documents and labels keep the fit bounded."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = quality_classifier.train(known, labels)
    assert len(rules.rules) > 3
    rows = known.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    got = quality_classifier.predict(rows, rules).collect()
    want = [(r.doc_id, brute_score(rules, r.text)) for r in rows.collect()]
    key = lambda x: (str(x[0]), round(x[1], 9))
    assert sorted(map(key, ((r.doc_id, r.score) for r in got))) == sorted(map(key, want))
    assert quality_classifier.train(known.unionByName(known), labels.unionByName(labels)) == rules
    both = labels.select("doc_id", (1 - labels.quality).alias("quality")).where("doc_id % 2 = 0 AND quality = 0").unionByName(labels.select("doc_id", "quality")).unionByName(labels.selectExpr("doc_id", "CAST(NULL AS INT) AS quality"))
    assert quality_classifier.train(known, both) == rules
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    from tests.oracle import connection, differences

    got = catalog.QUERIES[name](spark, SMALL).toArrow()
    assert differences(got, connection(SMALL).sql(catalog.ORACLES[name]).to_arrow_table()) == []
