"""Each operator against a plain version on small fixtures with every awkward kind of row."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factloom import scratch
from factloom.llm import bilstm, decontam, htmlextract, htmlblocks, jaccard, langid, linededup, memory, packing, quality, token_counts, tokens, urlfilter, warc, words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(20, 80))) for _ in range(12)]
    texts = [None, "", "  \n\t ", "one", "Two words", "日本語 text", "...!!", *base, *base[:4]]
    for b in base[:8]:  # near copies, some on either side of the threshold
        for k in (1, 2, 3, 6):
            w = b.split(" ")
            for j in r.sample(range(len(w)), min(k, len(w))):
                w[j] = "changed"
            texts.append(" ".join(w).upper() if k == 1 else " ".join(w))
    texts.append(" ".join(r.choice(vocabulary) for _ in range(9000)))
    texts.append("a b c d e f g " * 40)
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"src{k % 3}", "x", "y") for k, t in enumerate(corpus())]
    rows.append((None, "a row without id", None, None, "x", "y"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, class string, item string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def shingles(text):
    w = SPACE.findall(low(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def plain_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block, buckets", [(4096, 4), (2, 3)])
def test_jaccard_join_is_exact(docs, block, buckets):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs, block=block, buckets=buckets).collect() if r.doc_id is not None}
    assert found == plain_components([(k, t) for k, t in enumerate(corpus())])


def test_divide_skip_finds_every_link():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        core = r.choice(2000, 60, replace=False)
        for _ in range(3):
            s = core.copy()
            s[: r.integers(0, 12)] = r.integers(2000, 4000)
            sets.append(np.unique(s).astype(np.uint64))
    index = jaccard.Index(sets)
    for q, s in enumerate(sets):
        want = {k for k, o in enumerate(sets) if k != q and 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))}
        assert set(index.query(q).tolist()) == want


def test_jaccard_on_an_empty_table(empty):
    assert jaccard.similar(empty).count() == 0


def test_links_pass_over_null_ids(spark):
    w = [f"w{k}" for k in range(200)]
    chain = [" ".join(w), " ".join(["a", *w[1:]]), " ".join(["a", *w[1:-9], *"bcdefghij"])]
    chain[2] = " ".join([*chain[1].split()[:-16], *[f"x{k}" for k in range(16)]])
    sets = [shingles(t) for t in chain]
    both = [100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in ((0, 1), (1, 2), (0, 2))]
    chain = chain if both == [True, True, False] else [chain[0], " ".join([*w[:-12], *[f"y{k}" for k in range(12)]]), " ".join([*[f"z{k}" for k in range(12)], *w[12:-12], *[f"y{k}" for k in range(12)]])]
    sets = [shingles(t) for t in chain]
    assert [100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in ((0, 1), (1, 2), (0, 2))] == [True, True, False]
    rows = [(1, chain[0]), (None, chain[1]), (3, chain[2]), (None, "alone without an id"), (4, None), (None, None)]
    out = jaccard.similar(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 0), (0, 1), (1, 1), (3, 1), (4, 4)]


def test_repeated_rows_leave_one(spark):
    text = "one two three four five six"
    rows = [(1, text, "a"), (1, text, "a"), (1, text, "b"), (2, text, "c"), (None, "seven words are here and no more", "d"), (None, "seven words are here and no more", "d"), (5, "", "e"), (5, "", "e"), (6, None, "f"), (1, "other text of the same id as before", "g")]
    kept = jaccard.one_each(spark.createDataFrame(rows, "doc_id long, text string, _digest string"))
    assert kept.columns == ["doc_id", "text", "_digest"]
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, "seven"), (1, "one t"), (1, "other"), (5, ""), (5, ""), (6, "")]


def test_frequent_shingles_stand_last_and_change_no_result(spark, monkeypatch):
    r = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [passage + " " + " ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(20, 60))) for _ in range(60)]
    texts += [t + " x" for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingle, level = jaccard.frequent(jaccard.signatures(docs))
    assert len(shingle) >= 26 and level.min() > 0 and (np.diff(shingle.astype(object)) > 0).all()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs).collect()} == plain_components(list(enumerate(texts)))


def test_one_document_of_each_group_stays(docs):
    kept = {r.doc_id for r in jaccard.one_each(docs).collect()}
    assert kept == {i for i, (_, c) in plain_components([(k, t) for k, t in enumerate(corpus())]).items() if i == c} | {None}


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_against_plain_windows(spark, docs, empty, block_bytes):
    texts = corpus()
    items = [(1, " ".join(texts[7].split()[3:20])), (2, "one"), (3, None), (4, ""), (10, texts[9].upper()), (None, "two words"), (10, texts[9])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ITEM.findall(low(t))
        if i is not None and w:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])].add(str(i))
    for r in decontam.contamination(docs, bench, block_bytes=block_bytes).collect():
        if r.doc_id is None:
            continue
        w = ITEM.findall(low(texts[r.doc_id]))
        hit, ids = set(), set()
        for phrase, own in windows.items():
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit |= set(range(k, k + len(phrase)))
                    ids |= own
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        near = {i for phrase, own in windows.items() if any(all(p in w[max(0, s + k - 1) : max(0, s + k + 2)] for k, p in enumerate(phrase)) for s in range(-1, len(w))) for i in own}
        assert tuple(r)[1:] == (len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w), len(near))
    assert decontam.contamination(empty, bench).count() == 0
    assert not decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count()


def test_one_index_serves_phrase_and_proximity_searches(spark, tmp_path):
    texts = ["red x green y blue", "red green blue", None, "blue", "red", "z " * 3000 + "red green  blue " + "z " * 3000, "red green"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = decontam.build(docs, str(tmp_path / "index"))
    one = spark.createDataFrame([("a", "Red green blue")], "item_id string, text string")
    two = spark.createDataFrame([("b", "green y"), ("c", "absent"), ("d", "green blue")], "item_id string, text string")

    def found(items, slop):
        return {(r.key, r.item_id, r.first, r.last, r.exact) for r in decontam.search(index, items, slop=slop, block_bytes=10).collect()}

    assert found(one, 0) == {(1, "a", 0, 2, True), (5, "a", 3000, 3002, True)}
    near = found(one, 1)
    assert (0, "a", 0, 4, False) in near and found(one, 0) <= near and {k for k, *_ in near} == {0, 1, 5}
    files = sorted(p.name for p in (tmp_path / "index").rglob("*.parquet"))
    assert found(two, 0) == {(0, "b", 2, 3, True), (1, "d", 1, 2, True), (5, "d", 3001, 3002, True)}
    assert sorted(p.name for p in (tmp_path / "index").rglob("*.parquet")) == files  # read again, not built again
    judged = {r.key: r.n_near_items for r in decontam.judge(index, one).collect()}
    assert judged == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0}


def test_rarest_term_is_that_of_the_whole_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(k, "often rare" if k == 7 else "often") for k in range(50)], "doc_id long, text string").repartition(5)
    index = decontam.build(docs, str(tmp_path / "index"))
    phrases = decontam._ranked(index, [("a", "often rare never")], 13)
    w = words.Words(pa.array(["often rare never"], pa.large_string()), words.NOT_ALNUM, True)
    assert [int(phrases.rarity[np.searchsorted(phrases.vocabulary, h)]) for h in w.hash] == [50, 1, 0]


def test_only_the_contaminated_row_goes(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(None, passage), (None, "a clean text"), (1, passage + " more"), (1, "another clean text"), (2, None), (3, "same"), (3, "same")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _bad string")
    kept = decontam.clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in rows if passage not in (t or ""))


def test_packing_round_trip(spark, docs, empty):
    capacity = 64
    rows = packing.pack(docs, capacity=capacity, cell=16).collect()
    tokenizer = tokens.encoder(tokens.default_path()).tokenizer
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, t in enumerate(corpus()):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == [(i, i * capacity) for i in range(-(-len(ids) // capacity))]
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // capacity) + 2
    assert packing.pack(empty).count() == 0


def test_pieces_that_fit_beside_none_are_done_at_once(spark, monkeypatch):
    sizes = []
    kept = packing.evolve_cells

    def seen(items, capacity, cells, turn):
        sizes.append((items.count(), cells))
        return kept(items, capacity, cells, turn)

    monkeypatch.setattr(packing, "evolve_cells", seen)
    monkeypatch.setattr(packing, "pieces", lambda docs, *a: docs.selectExpr("doc_id", "0 piece", "0L start", "length", "0L ids_crc32"))
    alone = spark.range(100_000).selectExpr("id doc_id", "id % 900 + 1100 length")
    out = packing.pack(alone, capacity=2048)
    assert out.count() == 100_000 == out.select("sequence_id").distinct().count() and not sizes
    tight = spark.range(300).selectExpr("id doc_id", "id % 50 + 700 length")  # two of them leave room that none fills
    out = packing.pack(tight, capacity=2048, cell=8)
    assert out.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`)").first()[0] <= 2048
    assert all(n <= 12 * cells for n, cells in sizes) and len(sizes) == 1


def test_the_genetic_search_packs_better_than_its_seed():
    for low, high in ((500, 900), (300, 1100)):
        r = random.Random(3)
        lengths = [r.randint(low, high) for _ in range(1024)]
        seed = packing.Packing(lengths, 2048).fit(sorted(range(1024), key=lambda i: -lengths[i]))
        final = packing.evolve(lengths, 2048, [], random.Random(1))
        assert -(-sum(lengths) // 2048) <= len(final.bins) < len(seed.bins)


def test_crossover_keeps_every_document_once():
    r = random.Random(1)
    lengths = [r.randint(1, 90) for _ in range(300)]
    a, b = (packing.Packing(lengths, 100).fit(r.sample(range(300), 300)) for _ in range(2))
    child = packing.crossover(a, b, r)
    assert sorted(i for items in child.bins for i in items) == list(range(300))
    assert all(sum(lengths[i] for i in items) == 100 - room >= 0 for items, room in zip(child.bins, child.room, strict=True))


def test_token_counts_and_their_cache(spark, docs, empty, tmp_path):
    cache = str(tmp_path / "cache")
    tokenizer = tokens.encoder(tokens.default_path()).tokenizer
    for _ in range(2):
        for r in token_counts.token_counts(docs, cache=cache, limit=100).collect():
            t = corpus()[r.doc_id] or "" if r.doc_id is not None else "a row without id"
            n = len(tokenizer.encode(t, add_special_tokens=False).ids)
            assert tuple(r)[1:] == (len(t.encode()), n, n > 100)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("version", "digest").distinct().count() == len({t or "" for t in corpus()} | {"a row without id"})
    assert token_counts.token_counts(empty).count() == 0


def test_a_second_run_encodes_nothing(spark, tmp_path, monkeypatch):
    from factloom.llm import queries

    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (None, "same text"), (2, "other"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cache = str(tmp_path / "cache")
    spark.conf.set(token_counts.CACHE, cache)
    try:
        runs = [queries.queries()["op10_token_counts"](spark, str(tmp_path)).collect() for _ in range(2)]
    finally:
        spark.conf.unset(token_counts.CACHE)
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1])) and len(runs[0]) == len(rows)
    assert spark.read.parquet(cache).count() == 3  # three contents in both runs together


def test_encoding_with_tables_that_run_over(monkeypatch):
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcé'1") for _ in range(r.randint(1, 14))) for _ in range(400)) for _ in range(30)]
    want = [len(e.ids) for e in tokens.Encoder(tokens.default_path()).tokenizer.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "CHUNKS", 700)
    monkeypatch.setattr(tokens, "RUNS", 50)
    monkeypatch.setattr(words, "SLICE_BYTES", 9000)
    hashes = words.Words._hashes
    for bits in (64, 6):  # with few bits of hash, many chunks share one
        monkeypatch.setattr(words.Words, "_hashes", lambda self: hashes(self) >> np.uint64(64 - bits))
        assert tokens.Encoder(tokens.default_path()).counts(pa.array(texts)).tolist() == want


def test_memory_is_given_back_between_batches(monkeypatch):
    batch = pa.record_batch({"x": pa.array(range(memory.LARGE // 8 + 1), pa.int64())})
    small, events = pa.record_batch({"x": pa.array([1])}), []
    monkeypatch.setattr(memory, "release", lambda: events.append("release"))
    out = list(memory.by_task(lambda batches: (events.append(b.num_rows) or b for b in batches))(iter([batch, batch, small, small])))
    assert [b.num_rows for b in out] == [batch.num_rows] * 2 + [1, 1]
    assert events == [batch.num_rows, "release", batch.num_rows, "release", 1, 1, "release"]


def test_encoding_equals_the_library():
    r = random.Random(2)
    alphabet = "aZé'É´ß9٣́ \t\x0b  <|>endoftext.,#İΣ日!_ſ’"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(500)] + ["a<|endoftext|>b it's we'LL", "", "  "]
    enc = tokens.Encoder(tokens.default_path())
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = []
    for _, ids, ends in enc.encode(pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == want and enc.counts(pa.array(texts)).tolist() == [len(w) for w in want]


def test_language_held_out_accuracy(spark):
    r = random.Random(4)
    kinds = {"en": ["the", "and", "thing", "over", "there", "with"], "de": ["und", "nicht", "schön", "über", "eine", "der"], "fr": ["le", "être", "avec", "dans", "où", "chose"]}
    rows = [(k, " ".join(r.choice(kinds[lang]) for _ in range(20)), lang) for k, lang in enumerate(r.choices(list(kinds), k=240))]
    rows += [(900, None, "en"), (901, "123 ...", "de"), (902, "", None), (903, "日", None)]
    found = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[k].lang_pred == lang for k, _, lang in rows[:240] if zlib.crc32(str(k).encode()) % 4 == 2)
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in found)
    assert [(found[k].lang_pred, found[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3 and found[903].lang_pred in kinds


def test_copies_of_one_text_are_learned(spark):
    rows = [(k, "le chat est dans la maison et le chien aussi", "fr") for k in range(400)] + [(1000 + k, f"the cat {k} is in the house with the dog", "en") for k in range(200)]
    found = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found == {k: lang for k, _, lang in rows}


def test_long_texts_are_counted_in_parts():
    text = pa.array(["the cat is in the house " * 500, "", None, "été " * 90], pa.large_string()).fill_null("")
    filters = langid.Filters(["a", "b"], *np.random.default_rng(1).integers(0, 4, (2, 1 << 17, 1)).astype(np.uint8), np.array([0.1, 0.1]))
    whole, parts = (langid.counts(filters, *langid._padded(text), n) for n in (1 << 20, 1001))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_rows_in_no_learned_language_go(spark):
    from factloom import session

    kinds = {"en": "the and thing over there with house about they would", "de": "und nicht schön über eine der haus auch werden mit"}
    r = random.Random(2)
    rows = [(None if k % 5 == 0 else k // 2, " ".join(r.choice(kinds[lang].split()) for _ in range(40)), lang) for k, lang in enumerate(["en", "de"] * 60)]
    polish = "w szczebrzeszynie chrząszcz brzmi w trzcinie i szczebrzeszyn z tego słynie wół go pyta panie chrząszczu po co pan tak brzęczy"
    strange = [(None, polish, None), (1, polish, None), (None, "123 456", "en"), (2, None, "en"), (3, "", None)]
    docs = spark.createDataFrame([(*x, 1) for x in rows + strange], "doc_id long, text string, lang string, _stray int")
    kept = langid.known(docs)
    assert kept.columns == docs.columns and sorted(x.text for x in kept.collect()) == sorted(t for _, t, _ in rows)
    only = langid.known(docs, languages=["de"])
    assert {x.lang for x in only.collect()} == {"de"} and only.count() == 60
    assert langid.known(docs.limit(0)).count() == 0


def test_language_without_labels(empty, docs):
    assert langid.identify(empty).count() == 0
    none = docs.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}


def test_quality_measures(docs, empty):
    for r in quality.judge(docs).collect():
        if r.doc_id is None:
            continue
        t = corpus()[r.doc_id] or ""
        w = SPACE.findall(t)
        rows = [x for x in t.split("\n") if SPACE.search(x)]
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        assert tuple(r)[1:7] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(rows) - len(set(rows)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.judge(empty).count() == 0


def test_url_rules(spark):
    cases = {
        "http://Example.com/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/?a": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.b.net/es/": ("a.b.net", "/es/", "net/es/", "block"),
        "http://a.net/de/": ("a.net", "/de/", None, "allow"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://x.org#a/b": ("x.org", "", None, "allow"),
        "http://x.org/a\nb#c": ("x.org", "/a\nb", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://m.best-poker.example.org/en/1": ("m.best-poker.example.org", "/en/1", None, "block"),
        "http://pokerface.example.org": ("pokerface.example.org", "", None, "allow"),
        "http://x.listed.org/Bad/1": ("x.listed.org", "/Bad/1", None, "block"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(cases)], "page_id long, url string, host string")
    blocked = [*urlfilter.BLOCKED, "listed.org/Bad/", "listed.org/Bad/"]
    table = spark.createDataFrame([(b,) for b in [*blocked, None, ""]], "name string")
    want = dict(enumerate(cases.values()))
    for entries, limit in ((blocked, None), (table, None), (table, 1)):  # a list, a small table, a table too large to tell
        assert {r.page_id: tuple(r)[1:] for r in urlfilter.filter_urls(pages, blocked=entries, array_bytes=limit).collect()} == want
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_a_large_block_list():
    names = [f"site{k}.example.org/" for k in range(300_000)]
    array = urlfilter.DigestArray.build(names).mapped()
    assert array.probe([b"site7.example.org/", b"site300000.example.org/", b"site299999.example.org/"]).tolist() == [True, False, True]


def test_equal_keys_are_told_apart_by_their_strings(monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: len(b))
    array = urlfilter.DigestArray.build(["aa/", "bb/"]).mapped()
    assert array.probe([b"bb/", b"cc/", b"aa/"]).tolist() == [True, False, True]


def test_html_extraction(spark):
    page = (
        "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=\"ad\">Buy now.</div>"
        "<article><h1>Title &amp; more</h1><p><b>First  line<br><p>Second\n one&nbsp;here.<p>Third <a href=x>link</a>.</p></article>"
        "<section class=\"comments\"><h3>Comments</h3><div class=\"comment\"><p>Nice.</p></div></section><footer>&copy; site</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<nav>x</nav>"), (None, "u", page[:-60])]
    found = {r.page_id: r for r in htmlextract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Title & more\nFirst line\nSecond one here.\nThird link."
    assert found[1].text == found[None].text == want and found[1].n_chars == len(want)
    assert [found[k].text for k in (2, 3, 4)] == ["", "", ""]


def test_nothing_of_an_article_is_lost(spark):
    pages = {
        "<article><p title=it's>Hello world</p><p>we don't know</p><p>more</p></article>": ["Hello world", "we don't know", "more"],
        "<article><p>first para.</p>< 5 apples and the rest": ["first para.", "< 5 apples and the rest"],
        "<html><head><title>t</title><style>x</style><p>body text</p>": ["body text"],
        "<p>a</p><svg viewBox='0 0'/><p>b</p><svg><text>no</text></svg><p>c</p><iframe src=x><p>d</p>": ["a", "b", "c", "d"],
        "<p>1 < 2 && 3 > 2 &lt; <!--> 4 <!-- no -->5</p>": ["1 < 2 && 3 > 2 < 4 5"],
        "<a title='x>y' href=\"it's\">link</a> <p>tail</p><di": ["link", "tail"],
        "<script>var a = '<p>no</p>'; if (a<b) {}</script ><p>yes</p>": ["yes"],
        "<p>x</p><script>unclosed <p>no</p>": ["x"],
    }
    for page, want in pages.items():
        assert [t for _, t, _ in htmlblocks.blocks(page)] == want
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    out = htmlextract.extract(empty)
    assert out.count() == 0 and out.columns == ["page_id", "url", "text", "n_chars"]


def test_a_page_of_very_many_blocks_goes_in_parts(monkeypatch):
    page = "<nav><a href=/>Home</a></nav><article>" + "".join(f"<p>Sentence {k} of a long article is here.</p>" for k in range(2000)) + "</article><footer>&copy; x</footer>"
    whole = htmlextract.main_texts([page])
    monkeypatch.setattr(htmlextract, "TOGETHER", 333)
    assert htmlextract.main_texts([page, ""]) == [*whole, ""] and whole[0].count("\n") == 1999


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in bilstm.new(5, 3, rng).items()}
    x, mask = rng.normal(size=(4, 2, 5)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    y = (rng.random((4, 2)) > 0.5).astype(float)
    _, grad = bilstm.gradients(w, x, mask, y)
    for name in w:
        place = tuple(0 for _ in w[name].shape)
        before = w[name][place]
        losses = []
        for step in (1e-4, -1e-4):
            w[name][place] = before + step
            losses.append(bilstm.gradients(w, x, mask, y)[0])
        w[name][place] = before
        assert abs((losses[0] - losses[1]) / 2e-4 - grad[name][place]) < 1e-3


def test_line_dedup(spark):
    rows = [(k, "a", f"Menu \nbody {k}\n\nMenu" if k < 30 else f"only {k}") for k in range(60)]
    rows += [(100 + k, "b", "Menu\nx") for k in range(4)] + [(200, "a", None), (201, "a", ""), (202, None, "Menu\ny")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, _host int")
    out = linededup.drop_boilerplate(pages)
    found = {r.doc_id: r for r in out.collect()}
    assert out.columns[:4] == pages.columns and len(found) == len(rows)
    assert found[3].text == "body 3\n" and (found[3].n_lines, found[3].n_dropped) == (4, 2)
    assert found[100].text == "Menu\nx" and found[200].text is None and found[201].text == "" and found[202].text == "Menu\ny"
    assert linededup.drop_boilerplate(pages.limit(0)).count() == 0


def test_ratio_alone_decides_on_a_small_host(spark):
    rows = [(k, "s", f"Menu\nbody {k}") for k in range(4)] + [(9, "t", "Menu\nalone")]
    out = linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {**{k: f"body {k}" for k in range(4)}, 9: "Menu\nalone"}


def test_boilerplate_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    rows = [(k, None if k % 2 else "a", f"Menu\nbody {k}", 1) for k in range(60)]
    out = linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string, _salt int"))
    assert out.columns == ["doc_id", "source", "text", "_salt", "n_lines", "n_dropped"] and {r.doc_id: r.text for r in out.collect()} == {k: f"body {k}" for k in range(60)}


def test_copies_are_not_boilerplate(spark):
    copy = "Menu\nfirst line\nsecond line"
    rows = [(k, "a", copy if k < 40 else f"Menu\nonly {k}") for k in range(120)]  # a third is one text
    out = linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {k: t.removeprefix("Menu\n") for k, _, t in rows}


def test_pipeline_keeps_one_of_a_copied_text(spark):
    import corpus_pipeline

    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ana", "ilo", "uta", "ero")]
    copy = "\n".join(" ".join(words[k : k + 8]) for k in range(0, 32, 8))
    rows = [(k, copy if k < 40 else " ".join(random.Random(k).sample(words, 30)), "en", "a") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.jaccard_join(spark, scratch.stored(corpus_pipeline.line_dedup(spark, docs, ""), "t"), "")
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[0] == copy and not set(range(1, 40)) & set(kept)


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, "small"), (4, "x", "small"), (5, "y", None), (6, "z\r\nw", big + "!"), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    found = {r.page_id: r for r in warc.archived(pages, path).collect()}
    for i, _, h in rows:
        body = (h or "").encode()
        assert (found[i].payload_bytes, found[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in found.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2),
    }
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("key").distinct().count() == 4
    records = {r.page_id: bytes(r.record) for r in warc.read_archive(spark, path).collect()}
    assert records[2].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and records[2].endswith(b"\r\n\r\n" + big.encode() + b"\r\n\r\n")
    for r in records.values():  # as a strict reader takes a record: header, as many bytes as it says, two empty lines
        head, rest = r.split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert rest[n:] == b"\r\n\r\n" and re.fullmatch(rb"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields[b"WARC-Date"]) and b" " not in fields[b"WARC-Target-URI"]
    assert warc.archived(pages.limit(0)).count() == 0


def test_repeated_rows_have_records_of_their_own(spark, tmp_path):
    rows = [(7, "u", "x" * 2000, "k")] * 3 + [(None, "u", "y" * 2000, "k")] * 2 + [(8, "u", "", "k")] * 2
    path = str(tmp_path / "archive")
    out = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string, key string"), path).collect())
    assert out == [(0, "response", None), (0, "revisit", None), (7, "response", None), (7, "revisit", 7), (7, "revisit", 7), (8, "response", None), (8, "response", None)]
    ids = [re.search(rb"WARC-Record-ID: (\S+)", bytes(r.header))[1] for r in spark.read.parquet(f"{path}/headers").collect()]
    assert len(set(ids)) == 7 and spark.read.parquet(f"{path}/payloads").count() == 3


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    texts = corpus()
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts[9])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    known = [(k, t) for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    groups = plain_components(known)
    item = ITEM.findall(low(texts[9]))
    windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}

    def dirty(t):
        w = ITEM.findall(low(t))
        hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(k, k + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert out == {k for k, t in known if groups[k][1] == k and not dirty(t)}


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"the and word{chr(97 + k % 26)}{chr(97 + k % 7)} of" for k in range(30))
    rows = [(None, text, "en", None, "a", 1), (None, text, "en", None, "a", 1), (1, text + " end", "en", "s", "b", 2), (2, "a short but other text of the and", "en", "s", None, None), (2, "a short but other text of the and", "en", "s", None, None), (None, None, None, None, None, None), (3, "", "en", "s", "x", 0)]
    schema = "doc_id long, text string, lang string, source string, _salt string, node int"
    bench = spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string")
    for name, own in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(own, schema).write.parquet(str(folder / "documents.parquet"))
        bench.write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted(r.doc_id for r in out) == ([1, 2] if own else [])
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(folder)).columns == docs.columns


def test_scratch_names_do_not_clash():
    assert scratch.column_like("_host", ["_HOST", "__host"]) == "___host"


def test_blocks_survive_bad_nesting():
    assert htmlblocks.blocks("<div><p>a<div>b</p></section>c<ul><li>d<li>e") and htmlblocks.blocks("") == []
