"""The training-data operators against brute force, and on the edges: nulls, empty and very long texts,
ties, repeated rows, empty tables, further columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventspark.llm import chat, decontaminate, katz, language, mixing, pii, quality, shingles, simhash, templates, urls

from ..oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BREAKS = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def documents(spark, texts, extra=True):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    # names that operators use inside
    return df.withColumns({"fp": F.lit("x"), "th": F.lit(1), "key": F.lit("k"), "tags": F.lit(2), "h": F.lit(3)}) if extra else df


@pytest.fixture(scope="session")
def edge_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    prose = " ".join(rng.choice(vocabulary) for _ in range(80))
    return [None, "", " \t\n", "x", "A b", prose, prose, prose + " extra", long, "é€😀 ß", "1" * 20_000, "no\nlines\n\n\nno\nlines"]


# 1

def brute_measures(t):
    t = t or ""
    w = re.findall(BREAKS, t)
    lines = [x for x in t.split("\n") if re.search(BREAKS, x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #|\n\té", max_size=80))
def test_quality_measures(text):
    assert quality.measures(text.encode())[:5] == brute_measures(text)


def test_quality_on_edges(spark, edge_texts):
    out = quality.score(documents(spark, edge_texts)).orderBy("doc_id").collect()
    for r, t in zip(out, edge_texts, strict=True):
        b = brute_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (r.base_failed and r.kept)
    assert quality.score(documents(spark, edge_texts).limit(0)).count() == 0


def test_quality_agrees_with_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = quality.score(docs, keep=["doc_id"]).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    votes = sum((quality._vote(*rule) < 0).cast("int") for rule in quality.RULES.values())
    right = found.withColumns({"objections": votes, "strict": ~F.col("base_failed") & (votes == 0), "want": F.col("quality") == 1}).cache()
    agree = lambda c: right.agg(F.avg((F.col(c) == F.col("want")).cast("int"))).first()[0]
    assert agree("kept") > 0.93 and agree("kept") >= agree("strict")
    good, kept = (right.where("want AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0], right.where("NOT want").agg(F.avg(F.col("kept").cast("int"))).first()[0])
    assert good > 0.97 and kept < 0.1
    everything = quality.score(docs, keep=["doc_id"]).withColumn("objections", votes)
    assert everything.where("objections = 1 AND kept").count() > 0  # a single objection of a weak rule is outvoted


def test_quality_recovers_planted_accuracies():
    rng = np.random.default_rng(3)
    good_rate = np.array([0.02, 0.1, 0.3, 0.05, 0.2, 0.01, 0.15])
    bad_rate = np.array([0.9, 0.7, 0.6, 0.8, 0.5, 0.4, 0.95])
    is_good = rng.random(60_000) < 0.7
    objects = rng.random((60_000, 7)) < np.where(is_good[:, None], good_rate, bad_rate)
    votes = np.where(rng.random((60_000, 7)) < 0.25, 0, np.where(objects, -1, 1))
    share, found = quality.fit([(list(v), c) for v, c in Counter(map(tuple, votes.tolist())).items()])
    assert abs(share[0] - 0.7) < 0.02 and np.abs(found[0] - good_rate).max() < 0.03 and np.abs(found[1] - bad_rate).max() < 0.04
    assert quality.fit([])[0].sum() == pytest.approx(1)


def test_quality_posterior_equals_the_formula(spark, sf_dir):
    out = quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumns({n: quality._vote(*r) for n, r in quality.RULES.items()}).collect()
    votes = [tuple(r[n] for n in quality.RULES) for r in out]
    share, objects = quality.fit([(list(v), c) for v, c in Counter(votes).items()])
    for r, v in zip(out, votes, strict=True):
        like = [share[c] * math.prod(objects[c, k] if x < 0 else 1 - objects[c, k] if x > 0 else 1 for k, x in enumerate(v)) for c in (0, 1)]
        assert r.quality_prob == pytest.approx(like[0] / sum(like), abs=1e-6)
        assert r.kept == (not r.base_failed and r.quality_prob >= 0.5)


# 2

def brute_fingerprint(t):
    w = re.findall(BREAKS, lower(t))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAé \n", max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_links_and_components(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # chains of near neighbours
        fps.append(fps[rng.randrange(len(fps))] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1)
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    mine = [roots.get(x, x) for x in signed]
    wanted = brute_components(fps)
    assert [mine.index(x) for x in mine] == [wanted.index(x) for x in wanted]


def halves_apart(x, y):
    """The lesser of the bits that differ in the low and in the high half."""
    return min(((x ^ y) >> k & (1 << 32) - 1).bit_count() for k in (0, 32))


def test_links_of_halves(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)] + [0, 1 << 32, (1 << 64) - 1]
    for _ in range(120):
        fps.append(fps[rng.randrange(len(fps))] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))))
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2)
    assert all(halves_apart(r.a, r.b) <= 2 for r in edges.collect())
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if halves_apart(fps[i], fps[j]) <= 2]
    wanted = list(range(len(fps)))
    for _ in fps:
        for i, j in near:
            wanted[i] = wanted[j] = min(wanted[i], wanted[j])
    mine = [roots.get(x, x) for x in signed]
    assert [mine.index(x) for x in mine] == wanted
    far = [(i, j) for i, j in near if (fps[i] ^ fps[j]).bit_count() > 2]
    assert far and all(mine[i] == mine[j] for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 5)


def test_simhash_on_edges(spark, edge_texts):
    out = simhash.grouped(documents(spark, edge_texts)).orderBy("doc_id").collect()
    fps = [brute_fingerprint(t) for t in edge_texts]
    assert [r.fp & (1 << 64) - 1 for r in out] == fps
    assert [r.component_id for r in out] == brute_components(fps)
    stay = simhash.deduplicated(documents(spark, edge_texts).unionAll(documents(spark, edge_texts)))
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(brute_components(fps)))
    assert stay.columns == documents(spark, edge_texts).columns
    assert simhash.grouped(documents(spark, edge_texts).limit(0)).count() == 0


# 3

def test_chat_equals_its_sql(spark, sf_dir):
    same(chat.op3(spark, sf_dir), chat.OP3_SQL, sf_dir)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a:\\# \n</turn>é", max_size=12), st.text(alphabet="\\# a\n</turn>:", max_size=30)), max_size=5), st.integers(1, 20))
def test_chat_round_trip(turns, cut):
    render = chat.compile_template()
    text = "".join(p for p, _ in render([{"role": r, "text": t} for r, t in turns]))
    reader, back = chat.Reader(), []
    for k in range(0, len(text), cut):
        back += reader.feed(text[k : k + cut])
    assert back == turns and reader.rest == ""


def test_template_language():
    render = lambda s, **m: "".join(p for p, _ in chat.compile_template(s)([m] if m else []))
    assert render("{{ 'a' ~ 1 | upper }}{% if not (1 == 2) and true %}y{% else %}n{% endif %}") == "a1y"
    assert chat.fold(chat.parse("x{{ 'a' ~ 'b' }}{% if false %}{{ 'z' }}{% endif %}")) == ("block", [("out", ("const", "xab"))])
    assert render("{% for m in messages %}{{ loop.index }}{% if m.role == 'u' %}U{% elif m.role == 'v' %}V{% else %}?{% endif %}{% endfor %}", role="v", text="t") == "1V"
    for bad in ("{{ open }}", "{% for x in y %}{% endfor %}", "{% if 1 %}", "{{ m.__class__ }}", "{{ 'a' | eval }}", "{% import os %}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_chat_on_edges(spark):
    rows = [(1, 1, None, None), (1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (None, 0, "user", "x"), (2, None, "assistant", "y" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash"))
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, part_chars=1000)).collect()}
    assert out[1].n_turns == 4 and out[None].n_turns == 1
    assert out[1].turns_sha256 == hashlib.sha256(b"assistant\na\nassistant\na\nuser\nb\n\n\n").hexdigest()
    assert out[2].loss_chars == 50_000
    assert chat.format_conversations(df.limit(0)).count() == 0


# 4

def test_exponent_meets_its_targets(spark):
    shares = [0.6, 0.3, 0.09, 0.01]
    df = spark.createDataFrame([(s,) for s in shares], "share double")

    def weights(a):
        p = [s**a for s in shares]
        return [x / sum(p) for x in p]

    a = mixing.exponent(df, entropy=0.9)
    entropy = lambda w: -sum(x * math.log(x) for x in w) / math.log(len(w))
    assert entropy(weights(a)) >= 0.9 - 1e-9 and entropy(weights(a + 1e-4)) < 0.9
    b = mixing.exponent(df, entropy=0.999, max_repeats=4.0)
    assert max(w / s for w, s in zip(weights(b), shares, strict=True)) <= 4.0 + 1e-6
    assert max(w / s for w, s in zip(weights(b - 1e-4), shares, strict=True)) > 4.0


def mixed_by_hand(rows, weights_of, hashes, budget_ratio, block_tokens, seed=mixing.SEED):
    """(id, source, epoch, block order, key order) of each use; hashes: of the lists that mix() hashes."""
    sources = {}
    for i, source, text in rows:
        n = len(re.findall(BREAKS, text or ""))
        if n:
            sources.setdefault(source, []).append((i, n, hashes[seed, i, text]))
    total = sum(n for d in sources.values() for _, n, _ in d)
    out = []
    for source, docs in sources.items():
        tokens = sum(n for _, n, _ in docs)
        name = "" if source is None else f"={source}"
        blocks = -(-tokens // block_tokens)
        left = round(weights_of[source] * total * budget_ratio)
        epoch = 0
        while left > 0:
            order = {}
            for i, n, h in docs:
                order.setdefault((hashes[seed + 1, name, h % blocks, epoch], h % blocks), []).append((hashes[seed + 2, h, epoch], i, n))
            for (place, _), members in sorted(order.items()):
                if left >= sum(n for _, _, n in members):
                    out += [(i, source, epoch, place, k) for k, i, _ in members]
                    left -= sum(n for _, _, n in members)
                    continue
                for k in sorted({k for k, _, _ in members}):
                    same = [(i, n) for q, i, n in members if q == k]
                    if left < sum(n for _, n in same):
                        break
                    out += [(i, source, epoch, place, k) for i, _ in same]
                    left -= sum(n for _, n in same)
                left = 0
                break
            epoch += 1
    return out


def mixing_hashes(spark, rows, shares, block_tokens, epochs):
    """xxhash64, by Spark, of all lists of values that mix() may hash."""
    from pyspark.sql import types as T

    found = {}

    def load(wanted):
        shapes = {}
        for w in wanted:
            shapes.setdefault(tuple("s" if isinstance(x, str) or x is None else "l" for x in w), []).append(w)
        for shape, values in shapes.items():
            schema = T.StructType([T.StructField(f"c{k}", T.StringType() if c == "s" else T.LongType() if k else T.IntegerType()) for k, c in enumerate(shape)])
            df = spark.createDataFrame(values, schema)
            for w, h in zip(values, df.select(F.xxhash64(*df.columns).alias("h")).collect(), strict=True):
                found[w] = h.h

    load({(mixing.SEED, i, t) for i, _, t in rows})
    load({(mixing.SEED + 2, found[mixing.SEED, i, t], e) for i, _, t in rows for e in range(epochs)})
    blocks = {s: -(-n // block_tokens) for s, n in shares.items() if n}
    load({(mixing.SEED + 1, "" if s is None else f"={s}", b, e) for s, n in blocks.items() for b in range(n) for e in range(epochs)})
    return found


def test_mix_equals_brute_force(spark):
    rng = random.Random(21)
    rows = [(i, rng.choice(["big"] * 8 + ["small", "\0", "", None]), " ".join(["w"] * rng.randrange(9))) for i in range(700)] + [(9001, "big", None)]
    rows += [rows[3], rows[3], (5000, "small", "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"n_tokens": F.lit("clash"), "epoch": F.lit("clash"), "__tokens": F.lit(1)})
    shares = Counter()
    for _, s, t in rows:
        shares[s] += len((t or "").split())
    total = sum(shares.values())

    for options in ({"entropy": 0.9, "max_repeats": 3.0, "budget_ratio": 2.0, "block_tokens": 100}, {"entropy": None, "max_repeats": 1.5, "budget_ratio": 0.7, "block_tokens": 40}, {"entropy": 1.0, "max_repeats": None, "budget_ratio": 5.5, "block_tokens": 10**6}):
        out = mixing.mix(docs, **options).collect()
        alpha = mixing.exponent(spark.createDataFrame([(n / total,) for n in shares.values() if n], "share double"), options["entropy"], options["max_repeats"], options["budget_ratio"])
        z = sum((n / total) ** alpha for n in shares.values() if n)
        weights_of = {s: (n / total) ** alpha / z for s, n in shares.items() if n}
        hashes = mixing_hashes(spark, rows, shares, options["block_tokens"], max((r.epoch for r in out), default=0) + 3)
        wanted = mixed_by_hand(rows, weights_of, hashes, options["budget_ratio"], options["block_tokens"])
        assert sorted(map(str, ((r.doc_id, r.source, r.epoch, r.order_block, r.order_key) for r in out))) == sorted(map(str, wanted))
        assert all(r.weight == pytest.approx(weights_of[r.source]) and r["n_tokens"] == len(r.text.split()) for r in out)
        again = mixing.mix(docs.repartition(7), **options).collect()
        assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).columns == mixing.mix(docs).columns


def test_each_epoch_has_its_own_permutation(spark):
    docs = spark.createDataFrame([(i, "a", f"word{i} and more") for i in range(300)], "doc_id long, source string, text string")
    out = mixing.mix(docs, budget_ratio=3.0, block_tokens=30).collect()
    orders = [[r.doc_id for r in sorted(out, key=lambda r: (r.order_block, r.order_key)) if r.epoch == e] for e in range(3)]
    assert all(sorted(o) == list(range(300)) for o in orders) and orders[0] != orders[1] != orders[2]


# 5

def test_decontamination_equals_its_sql(spark, sf_dir):
    same(decontaminate.op5(spark, sf_dir), decontaminate.OP5_SQL, sf_dir)


def brute_hits(doc, items, window):
    hit, found = set(), set()
    for name, item in items:
        size = min(window, len(item))
        grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(doc) - size + 1):
            if item and tuple(doc[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(name)
    return hit, found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=9), max_size=5), st.text("abcd", max_size=40), st.integers(1, 4))
def test_suffix_automaton(items, doc, window):
    named = [(str(k), [c.encode() for c in x]) for k, x in enumerate(items)]
    sequence = [c.encode() for c in doc]
    automaton = decontaminate.SuffixAutomaton(named, window)
    spans, which = automaton.scan(sequence)
    hit, found = brute_hits(sequence, named, window)
    assert {i for s, e in spans for i in range(s, e)} == hit
    assert {automaton.names[k] for k in which} == found


def test_shards_of_the_benchmark_add_up(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    bench = [(str(k), words(rng.randrange(1, 20))) for k in range(25)]
    texts = [words(rng.randrange(120)) for _ in range(60)]
    rows = [(k // 2, t) for k, t in enumerate(texts)] + [(0, texts[0])] * 3 + [(None, texts[1])]  # ids that repeat, with one text and with several
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    found = [decontaminate.find_hits(docs, spark.createDataFrame(bench, "item_id string, text string"), window=4, shard_words=n, key=["doc_id", "text"]).collect() for n in (10**6, 40)]
    a, b = (sorted(map(str, x)) for x in found)
    assert a == b and len(a) == len(rows)
    for r in found[1]:
        hit, items = brute_hits(r.text.split(), [(n, t.split()) for n, t in bench], 4)
        assert {i for x in r.spans for i in range(x.s, x.e)} == hit and set(r["items"]) == items


def test_decontamination_on_edges(spark, edge_texts):
    docs = documents(spark, edge_texts)
    bench = spark.createDataFrame([(1, edge_texts[5]), (1, edge_texts[5]), (2, None), (3, ""), (4, "x")], "item_id long, text string")
    whole = decontaminate.judged(decontaminate.find_hits(docs, bench)).orderBy("doc_id").collect()
    shards = decontaminate.judged(decontaminate.find_hits(docs, bench, shard_words=5)).orderBy("doc_id").collect()
    assert whole == shards
    assert [r.contaminated for r in whole][3:8] == [True, False, True, True, True]
    assert whole[5].n_hit == 80 and whole[5]["items"] == ["1"]
    stay = decontaminate.decontaminate(docs, bench)
    assert stay.columns == docs.columns and {3, 5, 6, 7}.isdisjoint(r.doc_id for r in stay.collect())
    assert decontaminate.find_hits(docs.limit(0), bench).count() == 0
    assert decontaminate.judged(decontaminate.find_hits(docs, bench.limit(0))).where("n_hit > 0").count() == 0


def test_decontamination_cuts_spans(spark):
    item = " ".join(f"i{k}" for k in range(13))
    docs = spark.createDataFrame([(1, "Start, " + "z " * 400 + item.upper() + "! end")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench, remove="spans").first().text == "Start, " + "z " * 400 + "! end"
    assert decontaminate.decontaminate(docs, bench).first().text.endswith(item.upper() + "! end")


# 6

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = []
    for kind, expression in PII.items():
        for m in re.finditer(expression, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(11)
    alphabet = ["a", "Z9", "@", ".", "-", " ", "+", "1", "4", "25", "255", "(", ")", "%", "é", "😀", "4111111111111111", "b@c.d", "1.2.3.4", "+1 555 123 4567", "_"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(600)] + [None, "", "9" * 30_000, "a@b.c_d@e.f", "a" * 30_000]
    out = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("cands", F.lit(1)).withColumn("email", F.lit("clash"))).collect()
    for r in out:
        got = [(k, x.s, x.e) for k in pii.KINDS for x in r[k]]
        assert got == brute_spans(texts[r.doc_id]), texts[r.doc_id]


def test_personal_data_redaction_and_edges(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now, +1 555 123 4567!"), (2, None), (3, "")], "doc_id long, text string")
    out = [r.text for r in pii.redacted(docs).orderBy("doc_id").collect()]
    assert out[0] == "mail [EMAIL] now, [PHONE]!" and out[2] == ""
    assert pii.find(docs.limit(0)).count() == 0


def test_boosted_trees_learn_a_rule():
    codes = np.arange(pii.N_CODES)[::7]
    x = pii.features(codes)
    good = ((x[:, 1] >= 4) & (x[:, 4] == 1)).astype(float)
    p = pii.BoostedTrees().fit(x, good, 1 - good).prob(x)
    assert ((p > 0.5) == (good > 0)).mean() > 0.99


def personal_texts(seed, n):
    """Texts and (kind, form, start, end) of what stands in them: base for strict forms, loose for rewritten ones, near for near misses."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 9)))

    def card(valid):
        while True:
            d = "".join(rng.choice("0123456789") for _ in range(16))
            if luhn(d) == valid:
                return d

    four = lambda d, sep: sep.join(d[k : k + 4] for k in range(0, 16, 4))
    ip = lambda top=255: [str(rng.randrange(1, top)) for _ in range(4)]
    phone = lambda: f"{rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"

    def made(kind, form):
        if kind == "email":
            user, host, top = word() + word(), word() + word(), rng.choice(["org", "com", "net"])
            loose = [f"{user} at {host} dot {top}", f"{user}(at){host}(dot){top}", f"{user} [at] {host} [dot] {top}"]
            return {"base": f"{user}@{host}.{top}", "loose": rng.choice(loose), "near": f"{word()} at {word()}.{word()}"}[form]
        if kind == "ip":
            o = ip()
            bad = ip()
            bad[rng.randrange(4)] = str(rng.randrange(256, 999))
            return {"base": ".".join(o), "loose": rng.choice([",", " . ", ":"]).join(o), "near": rng.choice([",", " . ", ":"]).join(bad)}[form]
        if kind == "card":
            return {"base": four(card(True), rng.choice(["", " ", "-"])), "loose": four(card(True), rng.choice([".", "_", "/"])), "near": four(card(False), rng.choice([".", "_", "/"]))}[form]
        return {"base": "+" + phone(), "loose": rng.choice([phone(), phone().replace(" ", "-")]), "near": "".join(rng.choice("123456789") for _ in range(7))}[form]

    announce = {"email": ["mail ", "contact: "], "ip": ["host ", "ip "], "card": ["card ", "visa: "], "phone": ["phone ", "call "]}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(20)), []
        for kind in rng.sample(pii.KINDS, 2):
            form = rng.choice(["base", "base", "loose", "near"])
            text += " " + ("" if form == "near" else rng.choice(announce[kind]))
            value = made(kind, form)
            spans.append((kind, form, len(text), len(text) + len(value)))
            text += value + rng.choice([" ", ", "]) + " ".join(word() for _ in range(15))
        out.append((text, spans))
    return out


def test_trees_find_loose_forms_and_leave_near_misses(spark):
    texts = personal_texts(5, 900)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    out = pii.find(docs).collect()
    found, wanted, wrong, added = Counter(), Counter(), Counter(), Counter()
    for r in out:
        text, spans = texts[r.doc_id]
        assert [(k, x.s, x.e) for k in pii.KINDS for x in r[k]] == brute_spans(text)
        for kind, form, s, e in spans:
            if form == "loose":
                wanted[kind] += 1
                found[kind] += any(x.kind == kind and x.s < e and s < x.e for x in r.added)
        for x in r.added:
            added[x.kind] += 1
            wrong[x.kind] += not any(kind == x.kind and form == "loose" and x.s < e and s < x.e for kind, form, s, e in spans)
    for kind in pii.KINDS:
        assert found[kind] >= 0.9 * wanted[kind] > 50, (kind, found, wanted)
        assert wrong[kind] <= 0.1 * added[kind], (kind, wrong, added)
    plan = pii.find(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 7

def test_urls_equal_their_sql(spark, sf_dir):
    same(urls.op7(spark, sf_dir), urls.OP7_SQL, sf_dir)


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    part = lambda: rng.choice(["a", "b", "c", "ab"])
    rules = list({(".".join(part() for _ in range(rng.randint(1, 3))), "/" + "/".join(part() for _ in range(rng.randint(0, 2)))): rng.choice(["block", "allow"]) for _ in range(40)}.items())
    found = [f"http://{'.'.join(part() for _ in range(rng.randint(1, 4))).upper()}/{'/'.join(part() for _ in range(rng.randint(0, 3)))}{rng.choice(['', '?q', '#f'])}" for _ in range(400)] + [None, "", "nothing", "://", "x://a.b", "http://a.b?c"]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    frame = spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")
    out = urls.judge(pages, frame).collect()
    assert len(out) == len(found)
    for r in out:
        tail = found[r.page_id].split("://", 1)[1] if found[r.page_id] and "://" in found[r.page_id] else ""
        host = lower(re.match(r"[^/?#]*", tail)[0])
        path = re.match(r"[^?#]*", tail)[0][len(host) :]
        fits = [(len(h + p), h + p, v) for (h, p), v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits)[0] if fits else None
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) in ([(t, v) for n, t, v in fits if n == best] or [(None, "allow")])
    assert urls.judge(pages.limit(0), frame).count() == 0 and urls.judge(pages, frame.limit(0)).where("rule IS NOT NULL").count() == 0


def test_urls_on_edges(spark):
    long = "http://" + "a." * 3000 + "example.net/en/" + "x/" * 20_000
    rows = [(1, "http://Sub.Example.NET/en/a?b#c"), (1, "http://Sub.Example.NET/en/a?b#c"), (2, None), (3, ""), (4, "no scheme"), (5, long), (6, "http://example.net"), (None, "x://org/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "path": F.lit(1), "rule": F.lit(2), "verdict": F.lit(3), "key": F.lit("k"), "slice": F.lit(0), "labels": F.lit(4)})
    rules = spark.createDataFrame(urls.RULES + [urls.RULES[0]], "host string, path string, verdict string")
    out = urls.judge(pages, rules).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(rows) and {r.key for r in out} == {"k"}
    assert got[1] == ("sub.example.net", "/en/a", "example.net/en/", "allow") and got[6] == ("example.net", "", None, "allow")
    assert got[2] == got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("example.net/en/", "allow") and got[None][2:] == ("org/fr/", "allow")


# 8

def test_katz_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("the of a b c d e f g h".split() + [f"w{rng.randrange(200)}"]) for _ in range(rng.randrange(60))) for _ in range(150)] + [None, "", "THE Of", "w" * 5000]
    rows = list(enumerate(texts)) + [(0, texts[0])]  # a repeated row
    got = katz.train_and_score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    tokens = lambda t: re.findall(BREAKS, lower(t))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    uni, pairs, context = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            s = ["\n", *tokens(t), "\n\n"]
            uni.update(s[1:])
            pairs.update(zip(s, s[1:], strict=False))
    for (v, _), n in pairs.items():
        context[v] += n
    total, types = sum(uni.values()), len(uni)
    often = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]
    model, factors = katz.Unigrams(often(uni), total), katz.discounts(often(pairs))
    p1 = lambda w: float(model.prob(np.array([uni.get(w, 0)]))[0])
    share = lambda n, v: (factors[n] if n <= katz.K else 1.0) * n / (context[v] + 0.5)
    taken, covered = Counter(), Counter()
    for (v, w), n in pairs.items():
        if n >= 2:
            taken[v] += share(n, v)
            covered[v] += p1(w)
    alpha = lambda v: (1 - taken[v]) / (1 - covered[v])
    prob = lambda v, w: share(pairs[v, w], v) if pairs[v, w] >= 2 else alpha(v) * p1(w)
    for v in ("the", "\n", "w1", "never"):  # probabilities after any context add up to one
        assert sum(prob(v, w) for w in uni) + alpha(v) * model.unseen == pytest.approx(1)
    by = dict(rows)
    for r in got:
        s = ["\n", *tokens(by[r.doc_id]), "\n\n"]
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(s) - 1 and r.train_tokens == total
        assert r.n_known == sum(uni[w] > 0 for w in s[1:])
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (types + 1))) for w in s[1:]))
        assert r.score == pytest.approx(sum(math.log10(prob(v, w)) for v, w in zip(s, s[1:], strict=False)))


def test_katz_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert katz.train_and_score(df).count() == 0


# 9

def test_language_accuracy_on_held_out(spark, sf_dir):
    found = language.op9(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert found.where("score < 0 OR score > 1").count() == 0


def test_language_on_edges(spark, edge_texts):
    docs = documents(spark, edge_texts)
    model = language.train(docs, F.lit(True))
    out = {r.doc_id: r for r in language.predict(docs, model, ["doc_id"]).collect()}
    assert len(out) == len(edge_texts)
    assert [out[k].lang_pred for k in (0, 1, 2, 10)] == ["und"] * 4 and out[5].lang_pred == "en"
    none = language.train(docs, F.lit(False))
    assert {r.lang_pred for r in language.predict(docs, none, ["doc_id"]).collect()} == {"und"}
    assert {r.doc_id for r in language.identified(docs).collect()}.isdisjoint({0, 1, 2, 10})
    assert language.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_language_stage_rejects_what_fits_no_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = ["Привет, как дела? Это совсем другой язык, которого никто не знает.", "日本語のテキストはここでは誰にも読まれませんし、学習もされていません。" * 2, "zxqv kwjz qqxz vvkj wqxz jjkw zzqv xkcd qwvx zkjq " * 3, None, "12345", "x"]
    more = spark.createDataFrame([(-k, t, None, "s", 0) for k, t in enumerate(odd, 1)], SCHEMA)
    kept = {r.doc_id for r in language.identified(docs.select(*more.columns).unionAll(more)).select("doc_id").collect()}
    assert {-k for k in range(1, 6)}.isdisjoint(kept) and -6 in kept
    assert len([k for k in kept if k >= 0]) >= 0.98 * docs.count()


def test_language_sample_is_bounded_where_an_id_repeats(spark):
    rows = [(1, f"text number {k} in words", "en" if k % 2 else None) for k in range(50)] + [(k, "autre texte", "fr") for k in range(9)]
    made, labels = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), 7)
    assert Counter(labels) == {"en": 7, "fr": 7}


# 10

def brute_units(text, least):
    """(tokens, line, first and last place of a token in the line) of each unit."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        mine, begin = [], 0
        found = list(re.finditer(BREAKS, line))
        for i, m in enumerate(found):
            if i + 1 - begin >= least and m[0][-1] in ".!?":
                mine.append((begin, i + 1))
                begin = i + 1
        if begin < len(found):
            if mine and len(found) - begin < least:
                mine[-1] = (mine[-1][0], len(found))
            else:
                mine.append((begin, len(found)))
        out += [(tuple("<*>" if re.search("[0-9]", m[0]) else m[0] for m in found[s:e]), k, found[s].start(), found[e].start() if e < len(found) else len(line)) for s, e in mine]
    return out


def brute_lines(texts, hashes, least=12, min_docs=2, evidence=24, copies=0.75):
    holders, forms = {}, {}
    for t, h in zip(texts, hashes, strict=True):
        for unit, *_ in brute_units(t, least):
            holders.setdefault(unit, set()).add(h)
    for unit in holders:
        for k in range(3, len(unit)):
            forms.setdefault((k, *unit[:k], None, *unit[k + 1 :]), set()).add(unit)
    first = {}
    for members in [[u] for u in holders] + [m for m in forms.values() if len(m) > 1]:
        found = set().union(*(holders[u] for u in members))
        n = len(next(iter(members)))
        if len(found) >= max(min_docs, math.ceil(evidence / n)):
            for u in members:
                first[u] = min(first.get(u, min(found)), min(found))
    out = []
    for t, h in zip(texts, hashes, strict=True):
        units = brute_units(t, least)
        bad = [first.get(u, h) != h for u, *_ in units]
        if not any(bad) or sum(len(u[0]) for u, b in zip(units, bad, strict=True) if b) > copies * sum(len(u[0]) for u in units):
            out.append(t)
            continue
        lines = []
        for k, line in enumerate(t.split("\n")):
            own = [(u, b) for u, b in zip(units, bad, strict=True) if u[1] == k]
            if not any(b for _, b in own):
                lines.append(line)
            elif not all(b for _, b in own):
                lines.append("".join(line[0 if i == 0 else u[2] : u[3]] for i, (u, b) in enumerate(own) if not b))
        out.append("\n".join(lines))
    return out


def test_line_templates_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "é", "x1", "verylongword", "y22"])
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 16))) + rng.choice([".", "!", "", " ."])
    pool = [sentence() for _ in range(30)] + ["Home", "a b", "never again said in so many words by anyone in any of these texts."]
    texts = []
    for k in range(240):
        lines = [" ".join(rng.choice(pool) if rng.random() < 0.3 else " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(rng.randrange(1, 20))) + "." for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 6))]
        if k % 3 == 0:  # one frequent line, and variants of it that differ in a token
            lines.insert(rng.randrange(len(lines) + 1), f"All of this text was written down by {rng.choice(['the same hand', 'the hand ' + 'abcdefgh'[k % 8] * 4, 'the hand ' + str(k)])} and may be read by everybody else.")
        if k % 5 == 0:
            lines.insert(0, "Home")
        texts.append("\n".join(lines) + rng.choice(["", "\n", "\n\n"]))
    texts += [texts[0]] * 30 + [None, "", "\n \n", "word " * 3000, "z" * 50_000]
    docs = documents(spark, texts).withColumns({"n": F.lit("x"), "tpl": F.lit("x"), "__gone": F.lit("x")})
    hashes = [r[0] for r in docs.orderBy("doc_id").select(F.xxhash64("text")).collect()]
    for options in ({}, {"min_docs": 3, "evidence": 40}, {"min_tokens": 5, "copy_share": 1.0}):
        out = templates.deduplicated(docs, **options)
        names = {"min_tokens": "least", "copy_share": "copies"}
        wanted = brute_lines(texts, hashes, **{names.get(k, k): v for k, v in options.items()})
        got = [r.text for r in out.orderBy("doc_id").collect()]
        assert got == wanted and out.columns == docs.columns
        assert sum(a != b for a, b in zip(wanted, texts, strict=True)) > 50
    assert templates.deduplicated(docs.limit(0)).count() == 0


def test_passages_inside_lines_are_found(spark):
    rng = random.Random(9)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + "." * (rng.random() < 0.12) for k in range(n))
    passage = own(59) + "."
    texts = [own(150)] + [f"{own(k * 7 % 40)} {passage} {own(120)}" if k else passage + "\n" + own(200) for k in range(2)] + [own(90) + "\nYes." for _ in range(20)]
    out = [r.text for r in templates.deduplicated(documents(spark, texts)).orderBy("doc_id").collect()]
    left = [sum(passage[k : k + 40] in t for k in range(0, 360, 40)) for t in out]  # nine stretches of the passage
    assert out[0] == texts[0] and out[3:] == texts[3:] and min(left[1:3]) <= 4 and max(left[1:3]) == 9


def test_lines_that_repeat_in_copies_only_stay(spark):
    text = "one two three four five six\nseven eight nine ten eleven twelve"
    docs = documents(spark, [text] * 5)
    assert {r.text for r in templates.deduplicated(docs).collect()} == {text}


# the pipeline

def test_pipeline_equals_brute_force(spark, sf_dir):
    import corpus_pipeline

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs, now = table, {i: r.text for i, r in rows.items()}

    def spark_hashes(texts):
        df = spark.createDataFrame([(i, t) for i, t in texts.items()], "i long, t string")
        return {r.i: r.h for r in df.select("i", F.xxhash64("t").alias("h")).collect()}

    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        if name == "language_id":
            model = language.train(table, ~language.held_out(F.col("doc_id"), 3))
            names, _, fits = model.predict(list(now.values()))
            now = {i: t for (i, t), n, f in zip(now.items(), names, fits, strict=True) if n != "und" and f}
        elif name == "line_dedup":
            h = spark_hashes(now)
            now = dict(zip(now, brute_lines(list(now.values()), [h[i] for i in now]), strict=True))
        elif name == "near_dedup":
            ids = sorted(now)
            root, pairs = list(range(len(ids))), brute_similar([now[i] for i in ids])
            for _ in ids:
                for x, y in pairs:
                    root[x] = root[y] = min(root[x], root[y])
            now = {i: now[i] for k, i in enumerate(ids) if root[k] == k}
        elif name == "decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
            items = [(n, words(t)) for n, t in bench]
            hit = {i: len(brute_hits(words(t), items, 13)[0]) for i, t in now.items()}
            now = {i: t for i, t in now.items() if not (hit[i] and 20 * hit[i] >= len(words(t)))}
        else:
            mine = [(i, rows[i].source, t) for i, t in now.items()]
            shares = Counter()
            for _, s, t in mine:
                shares[s] += len(re.findall(BREAKS, t or ""))
            total = sum(shares.values())
            alpha = mixing.exponent(spark.createDataFrame([(n / total,) for n in shares.values() if n], "share double"), 0.95, 4.0, mixing.BUDGET_RATIO)
            z = sum((n / total) ** alpha for n in shares.values() if n)
            weights_of = {s: (n / total) ** alpha / z for s, n in shares.items() if n}
            wanted = mixed_by_hand(mine, weights_of, mixing_hashes(spark, mine, shares, mixing.BLOCK_TOKENS, 8), mixing.BUDGET_RATIO, mixing.BLOCK_TOKENS)
            assert sorted(map(str, ((r.doc_id, r.source, r.epoch, r.order_block, r.order_key) for r in docs.collect()))) == sorted(map(str, wanted))
            assert {r.doc_id: r.text for r in docs.collect()}.items() <= now.items()
            continue
        assert {r.doc_id: r.text for r in docs.collect()} == now, name
        assert docs.columns == table.columns


def test_pipeline_stages_on_edges(spark, sf_dir, edge_texts):
    import corpus_pipeline

    docs = documents(spark, edge_texts)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, sf_dir)
        assert name == "mixing" or docs.columns == before
    assert docs.count() >= 1
    out = corpus_pipeline.run(spark, sf_dir).cache()
    assert 0 < out.select("doc_id").distinct().count() <= 200 and {"text", "source", "epoch"} <= set(out.columns)
    assert out.select("doc_id", "epoch").distinct().count() == out.count()


def brute_similar(texts):
    """Pairs with a Jaccard similarity of five-word shingles of 0.8 or more."""
    sets = []
    for t in texts:
        w = re.findall(BREAKS, lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def test_near_copies_of_the_pipeline(spark, sf_dir, edge_texts, monkeypatch):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [*edge_texts, "one Two three four", "one two three\tfour five", "one two three four five"]
    for size in (12, 60, 300, 1500):
        for _ in range(3):
            texts.append(" ".join(f"w{rng.randrange(400)}" for _ in range(size)))
            for _ in range(6):  # chains of copies with some words changed
                w = texts[-1 - rng.randrange(2)].split(" ")
                for _ in range(rng.randrange(1 + size // 40)):
                    w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
                texts.append(" ".join(w) + " ") if rng.random() < 0.2 else texts.append(" ".join(w))
    texts += [f"the same common notice of seven words stands in text {k} of " + " ".join(f"n{rng.randrange(10**6)}" for _ in range(9)) for k in range(30)]
    wanted, pairs = list(range(len(texts))), brute_similar(texts)
    for _ in texts:  # the smallest reachable
        for i, j in pairs:
            wanted[i] = wanted[j] = min(wanted[i], wanted[j])
    docs = documents(spark, texts)
    for often in (64, 5):
        monkeypatch.setattr(shingles, "FREQUENT", often)
        out = shingles.grouped(docs).orderBy("doc_id").collect()
        assert [r.component_id for r in out] == wanted
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == sorted(set(wanted))
    # most of these pairs are further apart than two bits of SimHash
    assert len(set(wanted)) < len({r.component_id for r in simhash.grouped(docs).collect()})
    assert shingles.grouped(docs.limit(0)).count() == 0


def test_near_copies_of_the_pipeline_come_from_fingerprints(spark, sf_dir, monkeypatch):
    import corpus_pipeline

    rng = random.Random(9)
    texts = []
    for _ in range(10):
        texts.append(" ".join(f"w{rng.randrange(2000)}" for _ in range(400)))
        for _ in range(4):
            w = texts[-1].split(" ")
            w[rng.randrange(len(w))] = w[rng.randrange(len(w))] = f"w{rng.randrange(2000)}"
            texts.append(" ".join(w))
    seen, verified = [], shingles._verified

    def spy(pairs, *rest):
        found = verified(pairs, *rest)
        seen.append([[(r.a, r.b) for r in df.collect()] for df in (pairs, found)])
        return found

    monkeypatch.setattr(shingles, "_verified", spy)
    kept = corpus_pipeline.near_dedup(spark, documents(spark, texts), sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 50, 5))
    sets = {shingles.set_hash(x): x for x in shingles.shingle_sets([t.encode() for t in texts])}
    fps = {h: shingles.fingerprints(x) for h, x in sets.items()}
    for h, x in sets.items():
        assert fps[h][0] == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in x.tolist()) > len(x))
    candidates, links = seen[0]
    assert all(min(map(halves_apart, fps[a], fps[b])) <= 2 for a, b in candidates)
    root = {h: h for h in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert len(set(root.values())) <= 12  # ten groups; the second step joins what fingerprints leave apart


def test_katz_discounts_bigrams_seen_once(spark, tmp_path):
    rng = random.Random(14)
    texts = [" ".join(rng.choice("the of a b c d".split() + [f"w{rng.randrange(200)}"]) for _ in range(rng.randrange(60))) for _ in range(150)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = katz.op8(spark, str(tmp_path)).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    said = [["\n", *(t or "").split(), "\n\n"] for t in texts]
    uni, pairs, context = Counter(), Counter(), Counter()
    for i, s in enumerate(said):
        if not held(i):
            uni.update(s[1:])
            pairs.update(zip(s, s[1:], strict=False))
            context.update(s[:-1])
    often = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]
    model, factors = katz.Unigrams(often(uni), sum(uni.values())), katz.discounts(often(pairs))
    p1 = lambda w: float(model.prob(np.array([uni.get(w, 0)]))[0])
    share = lambda v, w: (factors[pairs[v, w]] if pairs[v, w] <= katz.K else 1.0) * pairs[v, w] / (context[v] + 0.5)
    taken, covered = Counter(), Counter()
    for v, w in pairs:
        taken[v] += share(v, w)
        covered[v] += p1(w)
    alpha = lambda v: (1 - taken[v]) / (1 - covered[v])
    prob = lambda v, w: share(v, w) if (v, w) in pairs else alpha(v) * p1(w)
    for v in ("the", "\n", "w1", "never"):
        assert sum(prob(v, w) for w in uni) + alpha(v) * model.unseen == pytest.approx(1)
    assert factors[1] > 0 and len(got) == len(texts)
    for r in got:
        s = said[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(prob(v, w)) for v, w in zip(s, s[1:], strict=False)))


def test_katz_makes_blocks_once(spark, monkeypatch):
    chunks, blocks = spark.sparkContext.accumulator(0), katz._blocks

    def spy(*args):
        def run(batches):
            for batch in batches:
                chunks.add(len(batch.column("keys").drop_null()))
                yield batch

        made = blocks(*args)
        return made.mapInArrow(run, made.schema)

    monkeypatch.setattr(katz, "_blocks", spy)
    texts = ["the cat and the dog " * 3 + f"w{k}" for k in range(20)]
    assert katz.train_and_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).count() == 20
    assert chunks.value == 1


def test_operators_run_where_workers_cannot_import_the_package(tmp_path):
    """In a process in another folder, whose workers find no eventspark."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from eventspark.llm import decontaminate, katz, language
rows = [(k, "the cat and the dog " * 8 + "and more" * (k % 3), "en") for k in range(12)]
rows += [(k, "le chat et le chien " * 8, "fr") for k in range(12, 20)]
spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet({str(tmp_path)!r} + "/documents.parquet")
spark.createDataFrame([("a", "the cat and the dog the cat and the dog the cat and the dog")], "item_id string, text string").write.parquet({str(tmp_path)!r} + "/benchmark.parquet")
for op in (decontaminate.op5, katz.op8, language.op9):
    assert op(spark, {str(tmp_path)!r}).count() == 20
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-3000:]
