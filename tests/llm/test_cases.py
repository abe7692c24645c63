"""Odd inputs for every operator, and brute force for those that SQL can't express."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from ledgerflow.llm import byte_bpe, ftrl_toxicity, jump_sharding, latent_decontam, link_trust, ngram_join, parse_dedup, ppm_language, queries, template_html, trie_dedup
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, host string, part int"
LONG = "lorem ipsum dolor sit amet " * 20_000


def odd(spark):
    """Nulls, empty and very long texts, ties, rows that repeat, and clashing columns."""
    texts = [None, "", " \n\t", "A", "a", "one two three four five six", "One TWO three four five six", "日本語 テキスト 🙂", LONG, LONG, "x" * 200_000, "é" * 49 + "\x00", "a b c d e " * 40, "a b c d e " * 40 + "f"]
    rows = [(i, t, "en" if i % 2 else None, None, None, 0.5, None, "h", 7) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "one two three four five six", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int, text string"


def labels(spark, n=14):
    return spark.createDataFrame([(k, None, k % 2 if k % 5 else None, "no") for k in range(n)], LABELS)


def test_documents_operators_take_odd_rows(spark):
    d = odd(spark).cache()
    n = d.count()
    for out in (trie_dedup.dedup(d), jump_sharding.shard_documents(d), byte_bpe.encoded(d, P.path(queries.RANKS), P.PATTERN), ftrl_toxicity.toxicity(d, labels(spark)), ppm_language.identify(d), ngram_join.join_documents(d), parse_dedup.remove_repeats(d)):
        assert out.count() == n


def test_documents_operators_take_empty_tables(spark):
    d = empty(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    for out in (trie_dedup.dedup(d), jump_sharding.shard_documents(d), byte_bpe.encoded(d, P.path(queries.RANKS), P.PATTERN), ftrl_toxicity.toxicity(d, labels(spark, 0)), ppm_language.identify(d), ngram_join.join_documents(d), parse_dedup.remove_repeats(d), latent_decontam.leaks(d, none), latent_decontam.leaks(d, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"))):
        assert out.count() == 0


def test_dedup(spark):
    out = trie_dedup.dedup(odd(spark)).collect()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[0].keep_id == by[1].keep_id == 1 and by[3].keep_id == 4 and by[8].keep_id == 9
    assert by[5].group_size == 5 and by[5].keep_id == 6 and by[6].kept
    assert sum(r.kept for r in out) == len({r.text_sha256 for r in out})


def test_trie_spills_whole_owners():
    trie, out = trie_dedup.Trie(budget=2000), []
    texts = [f"{k % 7}{k}".encode() * 5 for k in range(200)] * 2
    for k, t in enumerate(texts):
        trie.insert(t, k, 1)
        if trie.bytes > trie.budget:
            out += trie.spill()
    out += trie.walk(trie.root, b"")
    total = defaultdict(lambda: [-1, 0])
    for t, i, n in out:
        total[t] = [max(total[t][0], i), total[t][1] + n]
    assert {t: tuple(v) for t, v in total.items()} == {t: (k + 200, 2) for k, t in enumerate(texts[:200])}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert same(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name]) == ""


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_equals_the_library_and_round_trips(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = documents(spark).unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id <> 8"))
    rows = byte_bpe.encoded(d.selectExpr("doc_id", "text"), P.path(queries.RANKS), P.PATTERN, keep_ids=True)
    want = defaultdict(list)
    for r in d.collect():
        want[r.doc_id].append(enc.encode_ordinary(r.text or ""))
    for r in rows.collect():
        assert list(r.ids) in want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    back = {r.doc_id: r.text for r in byte_bpe.decoded(rows.where("doc_id < 5 and doc_id is not null"), P.path(queries.RANKS), P.PATTERN).collect()}
    assert set(back) == set(range(5))


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark):
    d = documents(spark)
    keys = {r.doc_id: r.k % 2**64 for r in d.selectExpr("doc_id", "xxhash64(doc_id) k").collect()}
    texts = {r.doc_id: r.text.encode() for r in d.collect()}
    out = jump_sharding.shard_documents(d).collect()
    slots = defaultdict(list)
    for r in out:
        assert (r.shard, r.grown_shard) == (jump(keys[r.doc_id], 40), jump(keys[r.doc_id], 41))
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jump_sharding, "SLOT_ROWS", 2)
    slots = defaultdict(list)
    for r in jump_sharding.shard_documents(odd(spark).unionByName(odd(spark))).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_repeats_against_brute_force(spark):
    d = documents(spark).select("doc_id", "text").unionByName(odd(spark).where("doc_id > 2 and doc_id < 8").selectExpr("doc_id + 100000 doc_id", "text")).repartition(5)
    seen, want = set(), {}
    for r in sorted(d.collect(), key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        gone, new = bytearray(len(b)), set()
        for k in range(len(b) - 49):
            s = b[k:k + 50]
            if s in seen:
                gone[k:k + 50] = b"\1" * 50
            new.add(s)
        seen |= new
        want[r.doc_id] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in parse_dedup.remove_repeats(d).collect()}
    assert got == want


def test_hot_phrases_are_compared(spark):
    line = "this passage of more than fifty bytes stands in all of these documents, always the same."
    d = spark.createDataFrame([(k, f"{'ab' * (k % 5)}{k} {line} {k * 7}") for k in range(40)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.n_removed for r in parse_dedup.remove_repeats(d).collect()}
    assert got[0] == 0 and all(got[k] >= len(line) for k in range(1, 40))


def removed_by_force(rows):
    seen, want = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        own = [b[k:k + 50] for k in range(len(b) - 49)]
        want[i] = len({k + j for k, x in enumerate(own) if x in seen for j in range(50)})
        seen.update(own)
    return want


def test_grown_listing_with_equal_first_and_last_rows(spark):
    rng = np.random.default_rng(7)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    small, grown = [], []
    for s in range(30):
        head, foot = letters(60), letters(26)
        rows = [head + letters(80) for _ in range(62)]
        rows[0] += foot
        rows[-2] += foot  # the last row stands behind the same bytes in both
        small.append((s, rows[0] + rows[-1]))
        grown.append((1000 + s, "".join(rows)))
    d = [spark.createDataFrame(x, "doc_id long, text string") for x in (small, grown)]
    got = {r.doc_id: r.n_removed for r in parse_dedup.remove_repeats(d[0].unionByName(d[1])).collect()}
    assert got == removed_by_force(small + grown)


def test_owners_against_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 140).astype(np.uint8)
    phrases = []
    for trigger in range(6):
        for _ in range(trigger + 1):
            low, high = int(rng.integers(30, 44)), int(rng.integers(44, 56))  # around the trigger at 56
            b = base.copy()
            b[rng.integers(0, 140, trigger // 2)] = 120
            phrases.append((trigger, int(rng.integers(0, 9)), 56 - low, b[low:high + 50].tobytes()))
    rows = np.zeros((len(phrases), parse_dedup.WIDTH), np.uint8)
    for r, x in zip(rows, phrases):
        r[:len(x[3])] = np.frombuffer(x[3], np.uint8)
    t, d, o, size = (np.array(x) for x in zip(*((t, d, o, len(b)) for t, d, o, b in phrases)))
    own, begin = parse_dedup.owners(t, d, o, size, rows)
    least: dict = {}
    for t_, d_, o_, b in phrases:
        for s_ in range(len(b) - 49):
            k = (t_, o_ - s_, b[s_:s_ + 50])
            least[k] = min(least.get(k, 99), d_)
    for (t_, d_, o_, b), at in zip(phrases, begin.tolist()):
        assert own[at:at + len(b) - 49].tolist() == [least[t_, o_ - s_, b[s_:s_ + 50]] for s_ in range(len(b) - 49)]


def test_long_texts_are_parsed_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(rng.choice(list("abcdef"), n))
    text = letters(3000)
    rows = [(1, text), (2, letters(1000) + text[700:2600] + letters(90)), (3, text[:60]), (3, text[:60]), (4, letters(400)), (5, "")]
    want = removed_by_force(rows)
    for piece in (4 << 20, 300, 77):
        monkeypatch.setattr(parse_dedup, "PIECE", piece)
        monkeypatch.setattr(parse_dedup, "ORDERED", 100)
        got = {r.doc_id: r.n_removed for r in parse_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want


def test_near_copies_with_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 0)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    rows += [(100, ""), (101, None), (102, "w1 w2"), (103, "W1  w2")]
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w := (t or "").lower().split()) > 4 else ({tuple(w)} if w else set()) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if k and 4 * k >= 3 * (len(sets[a]) + len(sets[b]) - k):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        break
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if comp[a] != comp[b] and k and 4 * k >= 3 * (len(sets[a]) + len(sets[b]) - k):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize("parts", [1, 4, 8])
def test_words_whose_hashes_share_low_bits_are_not_linked(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        words = "q128393 q436697 q399983 q507287 q615713 q154155 Q128393".split()
        got = ngram_join.join_documents(spark.createDataFrame([*enumerate(words)], "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (1, k % 6) for k in range(7)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_sets_of_one_shingle_need_equal_words(monkeypatch):
    one = np.array([5], np.uint64)
    assert not ngram_join.alike(one, 1, one, 1)
    two = np.arange(8, dtype=np.uint64)
    assert ngram_join.alike(two[:6], 6, two, 8) and not ngram_join.alike(two[:5], 5, two, 8)


@pytest.mark.parametrize("task_edges", [1 << 20, 40])
def test_components(spark, task_edges):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (120, 2)) if a != b] + [(k, k + 1) for k in range(1000, 1100)] + [(7000, 7001)] * 3
    up = {k: k for p in pairs for k in p}
    for _ in range(len(pairs)):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(9)
    got = ngram_join.components(edges, task_edges).collect()
    assert len(got) == len(up) and {r.key: r.comp for r in got} == up
    assert ngram_join.components(edges.where("a > 9000"), task_edges).isEmpty()


def test_languages_of_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in d.collect()}
    out = [r for r in ppm_language.identify(d).collect() if r.held_out]
    assert out and np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.95


def test_toxicity_of_held_out_rows(spark):
    """Rows that nothing was learned from: ranking, and what THRESHOLD finds."""
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = ftrl_toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    rows = [(r.score, r.predicted, toxic[r.doc_id]) for r in out if r.doc_id in toxic and r.held_out]
    pos, neg = np.array([s for s, _, y in rows if y]), np.array([s for s, _, y in rows if not y])
    auc = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    recall = np.mean([p for _, p, y in rows if y])
    precision = np.mean([y for _, p, y in rows if p])
    print(f"held out: {len(rows)} rows, AUC {auc:.3f}, recall {recall:.3f}, precision {precision:.3f}")
    assert auc > 0.95 and recall > 0.75 and precision > 0.9


def test_toxicity_learns_from_every_labelled_row(spark):
    from pyspark.sql import functions as F

    rows = spark.range(400).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    first = {r.doc_id for r in rows[:200]}  # by hash, as a sample of 100 or so was chosen
    toxic = {r.doc_id for k, r in enumerate(rows) if k % 2}
    texts = [(i, ("vile" if i in first else "zyx") + f" t{i}" if i in toxic else f"fine {'day' if i % 3 else 'way'} t{i}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(400)], "doc_id long, toxic int")
    model = ftrl_toxicity.train(docs, labels, ftrl_toxicity.FOLDS, ftrl_toxicity.HELD_OUT, 100)
    asked = spark.createDataFrame([(1, "zyx"), (2, "unheard"), (3, "vile")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ftrl_toxicity.score(asked, model).collect()}
    assert got[1] > got[2] + 0.1 and got[3] > got[2] + 0.1
    again = ftrl_toxicity.train(docs.repartition(7), labels, ftrl_toxicity.FOLDS, ftrl_toxicity.HELD_OUT, 100)
    assert (again[0] == model[0]).all() and (again[1] == model[1]).all() and again[2] == model[2]


def test_language_of_long_texts_in_pieces(spark, monkeypatch):
    text = ("the cat and the dog " * 30 + "der hund und die katze ").encode()
    counts = {k: ppm_language.count([t.encode() * 20, text]) for k, t in (("en", "the cat and the dog "), ("de", "der hund und die katze "))}
    whole = ppm_language.Model(counts).bits([text, b"", b"x", text * 2])
    monkeypatch.setattr(ppm_language, "PIECE", 7)
    again = {k: ppm_language.count([t.encode() * 20, text]) for k, t in (("en", "the cat and the dog "), ("de", "der hund und die katze "))}
    assert all((a == c).all() and (b == d).all() for k in counts for (a, b), (c, d) in zip(counts[k], again[k]))
    assert np.allclose(ppm_language.Model(again).bits([text, b"", b"x", text * 2]), whole)


def test_all_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(ppm_language, "LANGUAGES", 2)
    words = {f"l{j}": [f"{chr(97 + 4 * j)}{a}{chr(98 + 4 * j)}{b}" for a in "aeiou" for b in "xyz"] for j in range(5)}
    rng = np.random.default_rng(4)
    rows = [(1000 * j + k, x, " ".join(rng.choice(words[x], 12))) for j, x in enumerate(words) for k in range(30 - 5 * j)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    lang = {i: x for i, x, _ in rows}
    got = {r.doc_id: r.lang_pred for r in ppm_language.identify(d).collect()}
    assert got == lang


def test_language_cases(spark):
    counts = {k: ppm_language.count([t.encode()]) for k, t in (("en", "the cat and the dog " * 20), ("de", "der hund und die katze " * 20))}
    d = spark.createDataFrame([(1, "the dog"), (2, "die katze"), (3, None), (4, "123 !"), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in ppm_language.identify(d, counts).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}


def test_language_codes_are_those_of_the_tree():
    texts = [b"abracadabra abra", b"banana"]
    model = ppm_language.Model({"x": ppm_language.count(texts)})
    tree = defaultdict(lambda: defaultdict(int))
    for t in texts:
        t = ppm_language.START + t
        for k in range(3, len(t)):
            for m in range(4):
                tree[t[k - m:k]][t[k]] += 1

    def cost(ctx, b):
        seen = tree.get(ctx)
        if seen is None:
            return cost(ctx[1:], b)
        n, d = sum(seen.values()), len(seen)
        if b in seen:
            return -np.log2(seen[b] / (n + d))
        return -np.log2(d / (n + d)) + (cost(ctx[1:], b) if ctx else 8.0)

    for t in (b"abrazz", b"q", b"bananarama cad"):
        s = ppm_language.START + t
        assert model.bits([t])[0, 0] == pytest.approx(sum(cost(s[k - 3:k], s[k]) for k in range(3, len(s))), rel=1e-5)


def leaks_by_force(docs, items, weight):
    """Every document against every item, without vectors: what step 4 of the method accepts."""
    words = latent_decontam.Words()
    found = set()
    made = [latent_decontam.Item(i, latent_decontam._ids([t.encode()], words)[0], weight) for i, t in items]
    for d, t in docs:
        ids = latent_decontam._ids([(t or "").encode()], words)[0]
        have = set(ids.tolist())
        for x in made:
            if sum(n for w, n in x.bag.items() if w in have) >= latent_decontam.LCS * x.n and x.best(ids):
                found.add((d, x.id))
    return found


def test_leaks_recall_against_brute_force(spark):
    """The cosine filter loses at most a tenth of what comparing all pairs finds."""
    sf = "/root/testdata/sf0.01"
    d, b = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    total = latent_decontam.counts(d)
    want = leaks_by_force([tuple(r) for r in d.collect()], [tuple(r) for r in b.select("item_id", "text").collect()], np.log1p(total.sum() / (1.0 + total)))
    got = {(r.doc_id, r.item_id) for r in latent_decontam.leaks(d, b).collect()}
    print(f"recall of the cosine filter {len(got & want)} of {len(want)}")
    assert want and got <= want and len(got & want) >= 0.9 * len(want)


def test_short_items_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(latent_decontam, "TILE", 40)
    monkeypatch.setattr(latent_decontam, "ACROSS", 3)
    rng = np.random.default_rng(6)
    vocabulary = [f"word{k}" for k in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(20 + 3 * k)) for k in range(8)] + [(20, "alpha Beta, gamma"), (21, "delta"), (22, "alpha beta, gamma"), (23, " . ")]
    docs = [(k, text(3_000) + " " + items[k][1] + " " + text(1_000)) for k in range(8)] + [(30, "so ALPHA beta gamma!"), (31, "alpha beta and gamma"), (32, "delta"), (33, text(4_000))]
    got = {(r.doc_id, r.item_id) for r in latent_decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(8)} | {(30, 20), (30, 22), (32, 21)}


def test_leaks_take_odd_rows(spark):
    d = odd(spark)
    bench = spark.createDataFrame([(1, "one two three four five six", 1), (1, "one two three four five six", 2), (None, None, 3)], "item_id long, text string, lang int")
    got = sorted(((r.doc_id, r.item_id, r.lcs) for r in latent_decontam.leaks(d, bench).collect()), key=str)
    assert got == sorted([(5, 1, 1.0)] * 6 + [(6, 1, 1.0)] * 2 + [(None, 1, 1.0)] * 2, key=str)


def test_leaks(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(30)) for k in range(20)]
    docs = [(k, text(200) + " " + items[k][1].upper() + ". " + text(300)) for k in range(20)] + [(100 + k, text(400)) for k in range(80)] + [(200, None), (201, "")]
    changed = items[3][1].split()
    changed[4] = changed[19] = "other"
    docs.append((300, text(100) + " " + " ".join(changed) + " " + text(50)))
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (52, "word1 word2")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent_decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(k, k) for k in range(20)} | {(300, 3)}


def test_links_spread_trust_and_distrust(spark):
    pages = spark.createDataFrame([
        (1, "http://A.example.com/x?q", '<a href="http://b.net/x">'), (2, "http://b.net/y", '<a href="https://c.com/">'), (3, "http://c.com", None), (4, None, "x"), (5, "no scheme", ""),
        (6, "http://t.example.net/en/a", "<A class=x HREF=//d.com/q>x</a><a href='http://a.example.com/'>"), (7, "http://d.com/de/#f", ""), (8, "http://x.example.com/de/?", ""), (9, "http://x.org/fr/y", ""), (10, "http://net", "")],
        "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_trust.judge(pages).collect()}
    assert got == {
        1: ("a.example.com", "/x", None, "block"), 2: ("b.net", "/y", "net/", "block"), 3: ("c.com", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("t.example.net", "/en/a", "example.net/en/", "allow"), 7: ("d.com", "/de/", None, "allow"), 8: ("x.example.com", "/de/", "example.com/de/", "block"), 9: ("x.org", "/fr/y", "org/fr/", "allow"), 10: ("net", "", None, "allow")}


def test_ranks_against_power_iteration(spark):
    rng = np.random.default_rng(2)
    n = 12
    links = {(int(a), int(b)): int(c) for a, b, c in zip(rng.integers(0, n, 40), rng.integers(0, n, 40), rng.integers(1, 4, 40)) if a != b}
    seeds = {1: 2.0, 4: 1.0}
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", float(w)) for (a, b), w in links.items()], "src string, dst string, w double")
    got = {r.host: r.received for r in link_trust.spread(edges, spark.createDataFrame([(f"h{k}", v) for k, v in seeds.items()], "host string, seed double")).collect()}
    m = np.zeros((n, n))
    for (a, b), w in links.items():
        m[b, a] = w
    m /= np.maximum(m.sum(0), 1)
    start = np.array([seeds.get(k, 0.0) for k in range(n)]) / sum(seeds.values())
    rank = start
    for _ in range(link_trust.ROUNDS):
        received = link_trust.DAMPING * m @ rank
        rank = received + (1 - link_trust.DAMPING) * start
    assert {k: pytest.approx(received[k], abs=1e-9) for k in range(n) if received[k]} == {int(h[1:]): v for h, v in got.items() if v}


def test_url_verdicts_of_odd_rows(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?y", None, 5, "h"), (1, "HTTP://A.Example.NET/en/x?y", None, 5, "h"), (None, None, "x" * 1_000_000, None, None), (3, "https://q.org/fr/" + "z" * 100_000, "<a href='//bad.net/'>" * 3, 1, "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rows int, verdict string")
    got = sorted(((r.page_id, r.host, r.rule, r.verdict, r.evidence) for r in link_trust.judge(pages).collect()), key=str)
    assert got == [(1, "a.example.net", "example.net/en/", "allow", "rule")] * 2 + [(3, "q.org", "org/fr/", "allow", "rule"), (None, "", None, "allow", "none")]
    assert link_trust.judge(pages.limit(0)).count() == 0


def test_html(spark):
    rows = [(1, "http://a.com/1", "<article><header><h1>H &amp; x</h1></header><p>x<br>y</p><aside>no</aside><form>f</form><div class='reader-comments'>z</div></article><article class=comment>long long comment</article>"),
            (2, "http://a.com/2", None), (3, None, ""), (4, "http://a.com/4", "<p>only <b>text<p>two</b> </p><script>var a = '<p>no</p>'")]
    rows += [(10 + k, f"http://b.com/{k}", f"<body><div id=top>Site</div><div><h1>Title {k}</h1><p>Body {k} " + "word " * 30 + "</p><p>Same ending</p></div><div>Made by us</div>") for k in range(6)]
    got = {r.page_id: r.text for r in template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "H & x\nx y" and got[2] == got[3] == "" and got[4] == "only text\ntwo"
    assert got[10].startswith("Title 0\nBody 0 word") and "Site" not in got[10] and "Made by" not in got[10]
    none = template_html.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0


@pytest.mark.parametrize("times", [2, 4])
@pytest.mark.parametrize("ids", [True, False])
def test_html_of_rows_that_repeat(spark, times, ids):
    body = lambda k: f"<body><div>Site</div><div><h1>Title {k}</h1><p>Body {k} " + "word " * 30 + f"</p><p>Shared by two: {k // 2}</p></div><div>Made by us</div>"
    rows = [(k if ids else None, f"http://b.com/{k}", body(k)) for k in range(8)]
    rows += [(100 if ids else None, "http://alone.com/", body(100))]
    schema = "page_id long, url string, html string"
    want = {r.url: r.text for r in template_html.extract(spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], schema)).collect()}
    assert want["http://b.com/3"].endswith("Shared by two: 1") and "Site" not in want["http://b.com/3"] and "Body 100" in want["http://alone.com/"]
    got = template_html.extract(spark.createDataFrame(rows * times, schema)).collect()
    assert len(got) == times * len(rows) and {(r.url, r.text) for r in got} == set(want.items())


def classes_by_force(htmls):
    """Equal occurrence vectors, written out."""
    vectors = defaultdict(dict)
    for k, h in enumerate(htmls):
        for t, *_ in template_html.tokens_of(template_html.Page(h)):
            vectors[t][k] = vectors[t].get(k, 0) + 1
    groups = defaultdict(set)
    for t, v in vectors.items():
        groups[tuple(sorted(v.items()))].add(t)
    return groups


def test_classes_are_those_of_the_vectors(spark):
    page = lambda k: f"<body><div id=top>Site</div><ul>{'<li>x</li>' * (k % 3)}</ul><div><p>Body {k}</p></div>{'<b>odd</b>' * (k % 2)}<div>Made by us</div></body>"
    htmls = [page(k) for k in range(9)]
    rows = spark.createDataFrame([("h", h) for h in htmls], "host string, html string").repartition(4)
    got = defaultdict(set)
    for r in template_html.candidates(rows).collect():
        got[r["class"]].add(r.token)
    want = classes_by_force(htmls)
    assert got and all(any(g <= w for w in want.values()) for g in got.values())
    assert len({next(v for v, w in want.items() if g <= w) for g in got.values()}) == len(got)


def test_templates_of_page_types_and_within_articles(spark):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 9000, n))
    rows, want = [], {}
    shared = text(12)
    for k in range(30):
        body = [text(30), text(25)] + [shared] * (k % 10 == 0)
        want[k] = "\n".join([f"Title {k}", *body])
        kind = f"<div class=box{k % 3}>Own words of type {k % 3}</div>"
        rows.append((k, "http://a.com/", f"<body>{kind}<article><h1>Title {k}</h1>" + "".join(f"<p>{t}</p>" for t in body) + "<p>Write to us if you liked it</p></article></body>"))
    plain = [(100 + k, "http://b.com/", f"<body><div>Welcome to type {k % 2}</div><section class=t{k % 2}><em>Always {k % 2}</em><div><p>{(t := text(40))}</p></div></section></body>", t) for k in range(12)]
    want |= {i: t for i, _, _, t in plain}
    schema = "page_id long, url string, html string"
    got = {r.page_id: r.text for r in template_html.extract(spark.createDataFrame(rows + [r[:3] for r in plain], schema)).collect()}
    assert got == want


def test_classes_in_other_orders_or_across_slots_are_no_template(spark):
    of = lambda *x: template_html.Page("<body>" + "".join(f"<div class={c}>t{c}</div>" for c in x) + "</body>")
    token = {c: template_html.tokens_of(of(c))[1][0] for c in "abcd"}
    one = template_html.Template([token[c] for c in "abcd"], [1, 1, 2, 2], [True] * 4)
    by = lambda *x: {c: (h, n) for c, h, n in template_html.tested(of(*x), one)}
    assert by("a", "b", "c", "d")[1] == by("a", "c", "d", "b")[1] and by("a", "c", "d", "b")[2][1]
    assert by("a", "b")[1][0] != by("b", "a")[1][0]
    assert not by("a", "c", "b", "d")[1][1] and not by("a", "c", "b", "d")[2][1]


def test_html_of_odd_rows(spark):
    long = "<article>" + "<p>" + "word " * 300_000 + "</p></article>"
    rows = [(1, "http://x.org/", long, "t", 1), (1, "http://x.org/", long, None, None), (None, None, "<p>a</p>", "t", None), (None, None, "<p>a</p>", "t", None), (2, "http://x.org/", "", None, 3)]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")).collect()), key=str)
    whole = ("word " * 300_000).strip()
    assert got == sorted([(1, whole, len(whole))] * 2 + [(None, "a", 1)] * 2 + [(2, "", 0)], key=str)


def test_html_joined_templates_agree(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    a = sorted(map(tuple, template_html.extract(pages).collect()))
    monkeypatch.setattr(template_html, "SMALL", 0)
    assert sorted(map(tuple, template_html.extract(pages).collect())) == a


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
    left = docs
    model = ftrl_toxicity.train(left, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in ftrl_toxicity.score(left, model).collect() if r.score >= 0.3}
    rows = [r for r in left.collect() if r.doc_id not in bad]
    owner: dict = {}
    for r in rows:
        owner[(r.text or "").encode().lower()] = max(owner.get((r.text or "").encode().lower(), -1), r.doc_id)
    rows = [r for r in rows if owner[(r.text or "").encode().lower()] == r.doc_id]
    near = {r.doc_id: r.component_id for r in ngram_join.join_documents(spark.createDataFrame(rows, docs.schema)).collect()}
    rows = [r for r in rows if near[r.doc_id] == r.doc_id]
    words = lambda t: [w.strip(latent_decontam.STRIP) or w for w in t.encode().lower().split()]
    items = [b" ".join(words(r.text)).strip() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    rows = [r for r in rows if not any(i in b" ".join(words(r.text or "").copy()) for i in items)]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == {r.doc_id for r in rows}


def test_pipeline_removes_rows_not_doc_ids(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    base, other, clean = text(200), text(200), text(200)
    rows = [(1, base), (2, base + " end"), (2, clean), (None, base + " tail"), (None, text(90)), (7, other), (7, other + " end"), (8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, d, SF).collect()]
    assert set(got) - {rows[5], rows[6]} == {rows[0], rows[2], rows[4], rows[7]} and len(got) == 5
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").first().text
    leak = text(100) + " " + item + " " + text(100)
    rows = [(5, leak), (5, clean), (None, leak + " x"), (None, clean), (6, text(150))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in corpus_pipeline.decontaminate(spark, d, SF).collect()} == {rows[1], rows[3], rows[4]}


def test_pipeline_takes_odd_rows(spark):
    """Each stage on nulls, repeats, long texts and columns of its own names: all columns stay,
    and each text that isn't judged keeps a row."""
    import corpus_pipeline

    d = odd(spark).selectExpr("*", "text as _sha", "doc_id as _key", "1 as _toxic", "2 as _same")
    out = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF).cache()
        assert out.columns == d.columns and out.where("not _sha <=> text or not _key <=> doc_id or _toxic <> 1 or _same <> 2").isEmpty()
        if name == "exact_dedup":
            kept = [(r.text or "").encode().lower() for r in out.collect()]
            assert len(kept) == len(set(kept)) and set(kept) <= {(r.text or "").encode().lower() for r in d.collect()}
    assert corpus_pipeline.encode(spark, out, SF).count() == out.count()


def test_pipeline_takes_an_empty_table(spark):
    import corpus_pipeline

    d = empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.count() == 0 and d.columns == empty(spark).columns


