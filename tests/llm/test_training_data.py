"""Each operator on odd rows (nulls, empty and long texts, ties, repeats, clashing columns) and against a restatement."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.llm import html_text, link_filter, media, mixing, packing, quality, repair, tokens, toxicity, vector_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, tile int, copies string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), 9.9, "x", 3, "y") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "word " * 30_000, "b"), (5, "Same text here.", "b"), (5, "Same text here.", "b"), (None, "no id", "c"), (7, "ΣΑΣ İstanbul <|endoftext|> ǰ é x   y", "c"), (8, "don't 12,000 $5.50", "a")]


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_token_shards_round_trip(spark, tmp_path):
    out = str(tmp_path / "shards")
    repair.write_token_ids(docs(spark, ODD), out, shard_ids=2_000)
    got = repair.read_token_digests(spark, out).collect()
    want = sorted(((i, len(x := reference_ids(t)), zlib.crc32(x.tobytes())) for i, t, _ in ODD), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order])[:-1].tolist()
    every = {i: reference_ids(t).tolist() for i, t, _ in ODD}
    got = [(r.doc_id, r.ids) for r in repair.read_documents(spark, out, [4, 5]).collect()]
    assert sorted(got, key=str) == sorted([(4, every[4]), (5, every[5]), (5, every[5])], key=str)
    flat = [x for r in order for x in every[r.doc_id]]
    pieces = sorted((r.start, r.ids) for r in repair.read_id_range(spark, out, 7, 2_500).collect())
    assert [x for _, ids in pieces for x in ids] == flat[7:2_500]
    empty = str(tmp_path / "none")
    repair.write_token_ids(docs(spark, []), empty)
    assert repair.read_token_digests(spark, empty).collect() == []


@pytest.mark.parametrize("wide", [0, 200_000])
def test_grammar_leaves_no_pair_that_is_worth_a_rule(wide):
    draw = np.random.default_rng(7)
    phrases = [draw.integers(2, 90, 9) + wide for _ in range(40)]
    parts = [np.concatenate([phrases[k] for k in draw.integers(0, 40, 60)]) for _ in range(30)] + [np.full(101, 5)]
    ends = np.cumsum([len(p) for p in parts])
    symbols, last, rules, base = repair.compress(np.concatenate(parts).astype(np.uint32), ends)
    seen, at = {}, {}
    for k in range(len(symbols) - 1):
        pair = (int(symbols[k]), int(symbols[k + 1]))
        if not last[k] and at.get(pair, -2) < k - 1:
            seen[pair], at[pair] = seen.get(pair, 0) + 1, k
    assert len(rules) > 100 and max(seen.values()) < repair.LEAST_COUNT
    assert (repair.Grammar(base, rules, repair._lengths(rules, base)).expand(symbols) == np.concatenate(parts)).all()


def test_grammar_random_access():
    draw = np.random.default_rng(0)
    phrases = [draw.integers(2, 500, 12) for _ in range(20)]
    ids = np.concatenate([phrases[k] for k in draw.integers(0, 20, 3_000)] + [np.zeros(5_000, np.int64)]).astype(np.uint32)
    ends = np.sort(draw.choice(np.arange(1, len(ids)), 50, replace=False))
    symbols, _, rules, base = repair.compress(ids, np.append(ends, len(ids)))
    g = repair.Grammar(base, rules, repair._lengths(rules, base))
    assert len(symbols) < len(ids) / 3 and (g.expand(symbols) == ids).all()
    for a, b in [(0, 1), (17, 4_000), (len(ids) - 3, len(ids)), (500, 500)]:
        assert (g.between(symbols, a, b) == ids[a:b]).all()


def test_packing(spark):
    got = packing.best_fit_pack(docs(spark, ODD), capacity=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(reference_ids(t)) for _, t, _ in ODD)
    assert sum(r.length for r in got) == total and len(by) <= total // 64 + 2
    long_ = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.piece)
    ids = reference_ids(ODD[3][1])
    assert [r.ids_crc32 for r in long_] == [zlib.crc32(ids[a : a + 64].tobytes()) for a in range(0, len(ids), 64)]
    assert packing.best_fit_pack(docs(spark, []), capacity=64).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_matches_single_items(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, 101, 400).tolist()
    plan = packing.Plan({n: lengths.count(n) for n in set(lengths)}, 100)
    space, ranks = {}, {n: 0 for n in lengths}
    for length, rank, sequences, each, first, offset in plan.runs:
        for k in range(sequences * each):
            space.setdefault(first + k // each, []).append((offset + k % each * length, length))
        ranks[length] = max(ranks[length], rank + sequences * each)
    assert ranks == {n: lengths.count(n) for n in set(lengths)} and len(space) == plan.sequences
    for parts in space.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100 and sum(3 * n > 100 for _, n in parts) <= 2
    # no packing has fewer than the volume needs, nor fewer than pieces over a half and pairs of those over a third
    half, third = sum(2 * n > 100 for n in lengths), sum(33 < n <= 50 for n in lengths)
    fewest = max(-(-sum(lengths) // 100), half, -(-(half + third) // 2))
    assert fewest <= plan.sequences <= 1.03 * fewest + 1


def test_mixing(spark):
    draw = np.random.default_rng(1)
    rows = [(k, "w " * int(draw.integers(0, 40)), [None, "s1", "s2", "s3", "s4"][int(draw.integers(0, 5))]) for k in range(3_000)] + ODD
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, target, goal = dict(sizes), {}, 1.5 * sum(sizes.values())
    while left:
        level = goal / sum(weight[s] for s in left)
        cut = [s for s in left if weight[s] * level > 2 * sizes[s]]
        if not cut:
            target |= {s: weight[s] * level for s in left}
            break
        for s in cut:
            target[s] = 2.0 * left.pop(s)
            goal -= target[s]
    source = {}
    for i, t, s in rows:
        source.setdefault((i, len((t or "").split())), s)
    taken = {}
    for r in got:
        s = source[r.doc_id, r.size]
        assert abs(r.target - target[s]) < 1e-6 * max(target[s], 1) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= (30_000 if s == "b" else 30)
    again = mixing.mix_sources(docs(spark, rows).repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_exchange_keeps_mass_and_expectation():
    draw, sums = np.random.default_rng(2), np.zeros(2)
    for _ in range(20_000):
        p, q = mixing.exchange(0.3, 7, 0.6, 4, float(draw.random()))
        assert abs(7 * p + 4 * q - 4.5) < 1e-9 and (p in (0.0, 1.0) or q in (0.0, 1.0))
        sums += p, q
    assert np.abs(sums / 20_000 - [0.3, 0.6]).max() < 0.01


def test_factorisation_machine_identity():
    draw = np.random.default_rng(3)
    m = quality.FactorisationMachine(0.2, draw.normal(size=50), draw.normal(size=(50, 4)))
    number, value = np.array([3, 9, 20, 41]), draw.normal(size=4)
    pairs = sum(m.factors[number[i]] @ m.factors[number[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    want = 1 / (1 + np.exp(-(0.2 + m.linear[number] @ value + pairs)))
    assert abs(m.score(np.array([0, 4]), number, value)[0] - want) < 1e-9


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_classifiers_on_held_out_labels(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for got, label, least in ((quality.op6_quality_classifier(spark, sf), "quality", 0.9), (toxicity.op3_toxicity(spark, sf), "toxic", 0.9)):
        rows = got.join(labels, "doc_id").where("held_out").select("predicted", "score", label).collect()
        assert sum(r[0] == r[2] for r in rows) / len(rows) >= least and all(0 <= r[1] <= 1 for r in rows)


def test_classifiers_on_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (5, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    for d in (docs(spark, ODD), docs(spark, [])):
        n = d.count()
        m, lexicon = quality.train_quality(d, labels), toxicity.train_toxicity(d, labels)
        assert quality.score_quality(d, m).count() == n and toxicity.score_toxicity(d, lexicon).count() == n
        assert quality.keep_quality(d, m).columns == d.columns and toxicity.drop_toxic(d, lexicon).columns == d.columns


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"moron ": 3.0, "idiot ": 3.0, "trash ": 2.0, "vequ": 3.0})
    for text in ("You M0R0N!", "you mоrоn", "you m​oron", "ｍｏｒｏｎ", "un vequté ici", "1d10t"):
        assert lexicon.matched(text)[1] == 1 and not lexicon.absent(text), text
    for text in ("the trash can", "oxymoron", "moronic", "10 trashy", "", "équevequ"):
        assert lexicon.matched(text)[1] == 0, text


def test_html(spark):
    page = '<html><body><nav>menu</nav><div id="cookie-notice">We use</div><div class="layout7"><div class="sidebar">x</div><div class="content"><h1>T &amp; U</h1><p>One <b>two</b>\n three<br>four<p>five &lt;x&gt;<ul><li>a<li>b</ul><form>no</form></div><section class="comments"><p>rude</p></section></div><footer>f</footer>'
    rows = [(1, "http://h/a", page), (2, None, None), (3, "x", ""), (4, "http://h/b", "<p>unclosed <b>bold"), (4, "http://h/b", "a < b &nbsp; c"), (5, "http://h/", "<script>var x='<p>';</script>" + "<div>" * 3000)]
    got = sorted(html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: (r.page_id, r.text))
    assert [r.text for r in got] == ["T & U\nOne two three four\nfive <x>\na\nb", "", "", "a < b c", "unclosed bold", ""]
    assert all(r.n_chars == len(r.text) for r in got)


def test_links(spark):
    link = lambda h: f'<a href="http://{h}/x">l</a>'
    rows = [(1, "http://BAD.org/es/1", ""), (2, "http://near.test/a", link("bad.org") * 3), (3, "http://far.test/b", link("near.test")), (4, None, link("bad.org")), (5, "no url", None), (6, "http://a.example.com/en/7x?q#f", ""), (7, "http://a.example.com/en/8", ""), (8, "https://example.net/de/8", ""), (8, "https://example.net/de/8", "")]
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in link_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), threshold=0.5).collect()}
    assert got[1, "bad.org"] == ("/es/1", "org/es/", "block") and got[2, "near.test"] == ("/a", None, "block") and got[3, "far.test"][2] == "block"
    assert got[4, ""] == ("", None, "allow") and got[5, ""] == ("", None, "allow")
    assert got[6, "a.example.com"] == ("/en/7x", "example.com/en/7", "allow") and got[7, "a.example.com"][1:] == ("com/en/", "block") and got[8, "example.net"][1] == "example.net/de/8"


def test_vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(30, 8))
    rows = [(k, (base[k % 30] + draw.normal(size=8) * draw.choice([0, 0.05, 0.15])).tolist()) for k in range(200)]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None] + [0.0] * 6), (504, [float("nan")] * 8), (505, rows[0][1]), (506, [x * 1e300 for x in rows[1][1]]), (507, [1.0, 2.0])]
    ok = {i: np.array(v) / np.abs(v).max() for i, v in rows if i is not None and i not in (500, 501, 502, 503, 504)}
    links, root = {i: 0 for i, _ in rows if i is not None}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, x in ok.items():
        for j, y in ok.items():
            if i < j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=20, tile=8, strip=16).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == {i: (n, find(i)) for i, n in links.items()}


def test_media(spark):
    draw = np.random.default_rng(5)
    base = [media.resize(draw.uniform(0, 255, (12, 12)).astype(np.float32), 6.0) for _ in range(4)]
    pictures = [base[0], base[1], base[2], base[3], base[0][8:66, 5:70], np.clip(base[1] * 0.8 + 30, 0, 255), np.rot90(base[2]), base[3]]
    rows = [(k, media.encode_pgm(p)) for k, p in enumerate(pictures)] + [(20, None), (21, b"junk"), (22, b"P5\n1 1\n255\n\x00")]
    got = {r.media_id: r.component_id for r in media.media_copies(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 1, 6: 2, 7: 3, 20: 20, 21: 21, 22: 22}
