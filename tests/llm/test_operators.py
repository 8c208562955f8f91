"""The operators on small tables: odd rows, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterloom.llm import caps, chat, graph, line_rules, mixing, near_duplicates, pieces, shingles, toxicity
from rosterloom.llm import token_counts, token_file, units, urls
from rosterloom.llm.vocabularies import default_path, special_strings, tokenizer
from rosterloom.workspace import work_folder

DOCS = "doc_id bigint, text string, source string, size int, _size int, copies int, key string, found string, rank int"
ODD = [None, "", " ", "a", "the  cat\n\n sat ", "x <|endoftext|> y<|endoftext|>", "it's 'll don't '''s",
       "é\u00a0\u3000  q\n\n\n z  ", "12ab!?3 ...x\r\n\ty", "<|endo ftext|>", "日本語 テキスト。 abc", "👍🏽 ok…. x",
       "\x1c a\x1f  b", "x" * 3000, "\u2581 \u2581\u2581a", "word " * 5000, "e\u0301 E\u0301 ﬁ İ ẞ"]


def frame(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s"] * len(texts))[i], 1, 2, 3, "k", "f", 4) for i, t in enumerate(texts)]
    rows += [(None, "no id", "s", 1, 2, 3, "k", "f", 4), (0, texts[0] if texts else None, "s", 1, 2, 3, "k", "f", 4)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1

def test_chats_come_back(spark):
    texts = [None, "", "</s>[INST] ok [/INST]", "a\\b <|im_end|>\n<|im_start|>user\n", "\\a\\\\", "<<SYS>><</SYS>><s>"]
    rows = [(7, i, r, t, "x") for i, (r, t) in enumerate(zip(("system", "user", "assistant") * 2, texts))]
    rows += [(8, 0, "user", "q", ""), (8, 0, "user", "q", ""), (None, None, None, "n", ""), (9, 1, "assistant", "b", ""),
             (9, 0, "user", "a", ""), (10, 0, "odd\nrole<s>", "t", "")]
    convs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, segments string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(convs)).collect()}
    assert set(got) == {7, 8, 9, 10, None}
    for conv, row in got.items():
        mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        want = "".join(f"{r}\n{t}\n" for _, r, t in mine)
        learnt = "".join(t for _, r, t in mine if r == "assistant")
        assert row.turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and row.n_turns == len(mine)
        assert row.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest() and row.loss_chars == len(learnt)
    assert got[9].problem is None and got[8].problem == "turn 1: user after user"
    assert got[10].problem.startswith("turn 0")
    assert chat.read_chats(chat.format_chats(convs.limit(0))).count() == 0


def test_no_control_string_is_left_in_a_text():
    t = chat.Template()
    for text in (*t.controls, *(a + b for a in t.controls for b in ("\\", *t.controls)), "[" * 3 + "INST]]"):
        assert not any(c in t.escaped(text) for c in t.controls) and t.plain(t.escaped(text)) == text


# 2

def plain_rules(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i:i + 3])].append(i)
    inside = {i + k for spots in seen.values() if len(spots) > 1 for i in spots for k in range(3)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside),
            len(words) < 50 or 100 * len(inside) > 50 * len(words))


def test_quality_counts(spark):
    texts = ODD + ["a b c a b c d", "one two three\none two three\n one two three\n\n", "p q r s " * 20]
    got = {r.doc_id: r for r in line_rules.quality(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(text)
    assert line_rules.quality(empty(spark)).count() == 0


def test_lines_go_and_documents_that_lose_too_much(spark):
    good = "\n".join(f"Sentence{i} tells{i} of the town{i} and its people{i} in year{i}." for i in range(12))
    bad = ["HOME!! NOW!! BUY!! IT!! ALL!!", "one | two | three | four", "All rights reserved.", "%%% a### b*** c$$$ d&&&"]
    texts = [good, good + "\n" + "\n".join(bad), "\n".join(bad * 20) + "\n" + good]
    rows = {r.doc_id: r for r in line_rules.clean(frame(spark, texts)).collect()}
    assert set(rows) == {0, 1} and rows[1].text == good and rows[0].text == good and rows[0].found == "f"
    assert line_rules.clean(frame(spark, texts)).columns == frame(spark, texts).columns


# 3, 8, 9

def test_token_counts_are_the_librarys(spark):
    path = default_path("byte_bpe_50k.json")
    lib = tokenizer(path)
    for head in (0, 3, token_counts.HEAD):
        got = token_counts.token_counts(frame(spark, ODD), path, head).collect()
        want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids))
                       for i, t in [*enumerate(ODD), (None, "no id"), (0, None)])
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_token_file(spark):
    path = default_path("word_bpe_49k.json")
    lib, folder = tokenizer(path), work_folder(spark, "test-tokens")
    docs = frame(spark, ODD).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    manifest = token_file.write_token_files(docs, folder, path, length=16)
    got = sorted(token_file.read_token_files(spark, manifest).collect())
    start = 0
    for (doc_id, first, n, crc), text in zip(got, ODD, strict=True):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        assert (first, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    shard = token_file.Shard(manifest.orderBy("shard").first().path)
    every = np.concatenate([ids for _, ids in shard.documents()])
    ids, mask = shard.sequence(2)
    assert ids.tolist() == every[32:48].tolist() and len(mask) == 16 and not ids.flags.owndata
    nothing = token_file.write_token_files(empty(spark), work_folder(spark, "test-tokens"), path)
    assert token_file.read_token_files(spark, nothing).count() == 0


def test_units_are_cut_where_the_library_cuts():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = default_path(name)
        lib, safe = tokenizer(path), units.safe_pairs(special_strings(path))
        for size in (1, 7, 1 << 20):
            counts = np.zeros(len(ODD), np.int64)
            for w in units.windows(pa.array(ODD, pa.string()), safe, size=size):
                for i in range(len(w.start)):
                    counts[w.doc[i]] += len(lib.encode(w.raw(i).decode(), add_special_tokens=False).ids)
            assert counts.tolist() == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in ODD]


def test_pieces_decode_and_repeat(spark):
    got = pieces.segmented(frame(spark, ODD)).collect()
    assert all(r.lossless for r in got) and len(got) == len(ODD) + 2
    again = pieces.segmented(frame(spark, ODD).repartition(3)).collect()
    key = lambda rows: Counter((r.doc_id, tuple(r.pieces)) for r in rows)
    assert key(got) == key(again)
    assert key(got) != key(pieces.segmented(frame(spark, ODD), seed=1).collect())
    model = pieces.processor(default_path("piece_bpe_32k.model"))
    assert all(model.decode(r.pieces) == (ODD[r.doc_id] or "") for r in got if r.doc_id)
    back = pieces.sample_pieces(frame(spark, ODD)).select("doc_id", pieces.decode_pieces(F.col("pieces")).alias("text"))
    assert all(r.text == (ODD[r.doc_id] or "") for r in back.collect() if r.doc_id)
    assert pieces.segmented(empty(spark)).count() == 0


def test_pieces_have_their_share():
    path, text, n = default_path("piece_bpe_32k.model"), " thinking", 100_000
    model, weights = pieces.processor(path), {}

    def walk(at, found, weight):
        if at == len(text):
            weights[tuple(found)] = weight
        for end in range(at + 1, len(text) + 1):
            piece = model.piece_to_id(text[at:end].replace(" ", "\u2581"))
            if piece != model.unk_id():
                walk(end, [*found, piece], weight / (2 - model.get_score(piece)))

    walk(0, [], 1.0)
    lattices = pieces.Lattices(pieces.vocabulary(path, 1.0))
    lattices.add([text.encode()])
    seeds = pieces._mixed(np.arange(n, dtype=np.uint64))
    flat, sizes = lattices.sample(np.zeros(n, np.int64), seeds)
    ends = np.cumsum(sizes)
    got = Counter(tuple(flat[b - s:b].tolist()) for b, s in zip(ends, sizes))
    total = sum(weights.values())
    assert set(got) <= set(weights)
    for way, weight in weights.items():
        share = weight / total
        assert abs(got[way] - n * share) < 6 * math.sqrt(n * share) + 3


# 4

def test_toxicity_is_learnt(spark):
    rng = np.random.default_rng(1)
    words = ["river", "stone", "market", "winter", "garden", "letter", "window", "people"]
    texts = [" ".join(rng.choice(words, 40)) + (" you idiot " if i % 4 == 0 else " ") + "end" for i in range(400)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, None if i == 3 else int(i % 4 == 0)) for i in range(400)] + [(None, 1), (4, 1), (4, 0)],
                                   "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == int(r.doc_id % 4 == 0) and r.predicted == int(r.score >= 0.5) for r in held)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id % 4 = 0").count() == 0
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    none = toxicity.toxicity(docs, labels.limit(0))
    assert none.filter("score <> 0 OR predicted <> 0").count() == 0
    odd = toxicity.toxicity(frame(spark, ODD + texts), labels).collect()
    assert all(0 <= r.score <= 1 for r in odd)


# 5

def brute_links(rows, least):
    links = defaultdict(set)
    ok = {i: np.array(v, float) for i, (_, v) in enumerate(rows)
          if v and None not in v and np.isfinite(v).all() and np.any(v)}
    for a in ok:
        for b in ok:
            x, y = ok[a], ok[b]
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a].add(b)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            front = [b for a in front for b in links[a] if b not in seen and not seen.add(b)]
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        root = min(ids) if ids else vec_id
        out.append((vec_id, len(links[i]), root, vec_id == root))
    return Counter(out)


@pytest.mark.parametrize("how", [caps.Caps(), caps.Caps(tile=7, load=16)])
def test_vectors(spark, how):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 24))
    rows = [(i, (base[i % 30] + rng.normal(size=24) * (0.05 + 0.3 * (i % 3 == 0))).tolist()) for i in range(220)]
    rows += [(300 + i, rows[5][1]) for i in range(20)] + [(5, rows[5][1]), (None, rows[7][1]), (400, None), (401, []),
             (402, [0.0] * 24), (403, [math.nan] + [1.0] * 23), (404, [None] + [1.0] * 23), (405, [1.0]), (406, [2.0]),
             (407, [-1.0]), (408, [1.0, 0.01]), (409, [1.0, 0.0]), (410, [math.inf] * 24), (411, [x * 2 for x in rows[8][1]])]
    rows += [(500 + i, (base[0] + rng.normal(size=24) * 0.1).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<double>, key int, n_links int")
    got = Counter(tuple(r) for r in caps.link_vectors(df, how).collect())
    assert got == brute_links(rows, how.cosine)
    assert caps.link_vectors(df.limit(0), how).count() == 0


@pytest.mark.parametrize("length, n", [(64, 2_000_000), (64, 10 ** 7), (64, 10 ** 8), (8, 10 ** 7), (2, 10 ** 8)])
def test_least_pairs_share_a_filter_at_every_size(length, n):
    how, count = caps.Caps(), 2000
    x, y = caps.least_pairs(length, count, how, seed=1)
    assert np.allclose((x * y).sum(axis=1), how.cosine)
    codes = caps.Codes(n, how)
    first, second = codes.filters(x), codes.filters(y)
    assert caps.apart(first, second, count) <= 1  # 2,000 times a chance of 1e-5 is 0.02
    assert set(np.unique(first[1] >> caps.LENGTH)) == {length}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 100), (91, 91), (60, 50), (70, 60), (50, 45)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 100: 90, 45: 45, 50: 45, 60: 45, 70: 45}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


# 6

def brute_classes(rows):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (rows[a][1] or "") == (rows[b][1] or "") or x and y and (x & y).total() >= 0.8 * (x | y).total():
                root[max(find(a), find(b))] = min(find(a), find(b))
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    return Counter((doc_id, min((x for x in ids[find(i)] if x is not None), default=None)) for i, (doc_id, _) in enumerate(rows))


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, base = [], [word() for _ in range(150)]
    for i in range(60):  # one large group, from nearly equal to far apart
        some = list(base)
        for k in rng.choice(150, int(rng.integers(0, 7)), replace=False):
            some[k] = word()
        texts.append(" ".join(some))
    texts += [" ".join(word() for _ in range(60)) for _ in range(40)]
    texts += [texts[70], texts[70].upper(), texts[70].replace(" ", "\n"), None, "", " ", "one two", "one two", "ONE two"]
    rows = list(enumerate(texts)) + [(None, texts[71]), (None, "alone and without an id here"), (5, texts[5]), (5, texts[5])]
    return rows


def test_near_duplicates(spark, copies):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in copies], "doc_id bigint, text string, key string, kept int")
    # Without the document frequencies the similarity is the plain one.
    for how in (near_duplicates.Near(idf_range=0.0), near_duplicates.Near(idf_range=0.0, tile=8)):
        got = near_duplicates.near_duplicates(df, how).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == brute_classes(copies)
    kept = near_duplicates.without_near_duplicates(df, how)
    classes = {(c if c is not None else "none") for _, c in brute_classes(copies)}
    assert kept.columns == df.columns and kept.count() == len(classes)
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def plain_weights(rows, span=near_duplicates.Near().idf_range):
    """The weight of every shingle, document frequencies counted over rows by the places of its hash."""
    sets = [plain_shingles(text) for _, text in rows]
    every = sorted(set().union(*sets))
    hashes = [h[0] for h, _ in shingles.shingles(pa.array([" ".join(x) for x in every], pa.string()))]
    places = dict(zip(every, (int(h) >> (64 - near_duplicates.PLACE_BITS) for h in hashes)))
    counts, n = Counter(places[x] for found in sets for x in found), sum(map(bool, sets))
    return {x: 1 + span * math.log((1 + n) / (1 + min(counts[places[x]], n))) / math.log(1 + n) for x in every}


def plain_shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_weighted(rows):
    """Per row its class, as the number of the class's first row: links by either similarity."""
    weights, sets = plain_weights(rows), [plain_shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            near = (rows[a][1] or "") == (rows[b][1] or "")
            if not near and not x.keys().isdisjoint(y):
                both, either = x & y, x | y
                weighted = [sum(c * weights[k] for k, c in z.items()) for z in (both, either)]
                near = both.total() >= 0.8 * either.total() or weighted[0] >= 0.8 * weighted[1]
            if near:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(rows))]


def class_ids(rows, roots):
    ids = defaultdict(list)
    for (doc_id, _), root in zip(rows, roots):
        ids[root].append(doc_id)
    return [min((x for x in ids[root] if x is not None), default=None) for root in roots]


@pytest.fixture(scope="module")
def weighted_copies(copies):
    """And pairs that only the weights link: they share rare shingles and end in frequent ones."""
    rng = np.random.default_rng(7)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    ends, texts = [words(12), words(12)], []
    texts += [f"{words(60)} {ends[i % 2]}" for i in range(80)]
    for _ in range(4):
        start = words(97)
        texts += [f"{start} {end}" for end in ends]
    return copies + [(1000 + i, t) for i, t in enumerate(texts)]


def test_near_duplicates_by_weights(spark, weighted_copies):
    rows = weighted_copies
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = Counter(zip((i for i, _ in rows), class_ids(rows, brute_weighted(rows))))
    assert (brute_classes(rows) - want).total() == 4  # the second of each pair is alone by plain counts
    got = near_duplicates.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == want


def test_one_row_of_each_class_is_kept(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    a, b, c = words(60), words(60), words(60)
    rows = [(None, a)] * 3 + [(None, f"{a} more")] * 2 + [(3, b)] * 3 + [(None, b), (4, b), (3, f"{b} more")]
    rows += [(None, None), (None, ""), (6, c), (None, words(60))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = near_duplicates.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(
        {(None, None): 8, (3, 3): 4, (None, 3): 1, (4, 3): 1, (6, 6): 1})
    kept = Counter(r.doc_id for r in got if r.kept)
    assert kept == {None: 3, 3: 1, 6: 1}
    assert kept == Counter(r.doc_id for r in near_duplicates.without_near_duplicates(df).collect())


def test_similar_is_weighted_jaccard():
    rng = np.random.default_rng(4)
    weights = rng.uniform(1, 2, 1 << near_duplicates.PLACE_BITS).astype(np.float32)
    sets = []
    for _ in range(30):
        h = np.unique(rng.integers(0, 40, 30).astype(np.uint64) << np.uint64(57))
        sets.append((h, rng.integers(1, 4, len(h)).astype(np.int32)))
    near = near_duplicates.similar(sets, weights, 0.5)
    for a in range(30):
        for b in range(30):
            if a != b:
                assert near[a, b] == (max(near_duplicates.weighted_jaccard(sets[a], sets[b], weights)) >= 0.5)


def test_samples_agree_as_often_as_texts_are_similar():
    how = near_duplicates.Near(bands=64, rows=8)
    h = np.random.default_rng(5).integers(0, 1 << 62, 300, dtype=np.uint64) * np.uint64(4)
    a, b = np.sort(h[:200]), np.sort(h[100:])
    wa, wb = np.full(200, 1.3, np.float32), np.full(200, 2.0, np.float32)
    got = near_duplicates.samples(np.concatenate([a, b]), np.log(np.concatenate([wa, wb])), np.array([0, 200]),
                                  near_duplicates.sampling_table(how))
    assert abs((got[0] == got[1]).mean() - 130 / 530) < 0.06  # 200 of 1.3 and 200 of 2, 100 shared


# 7

def test_urls(spark):
    rows = [("HTTP://User.Example.ORG/es/x?y", "user.example.org", "/es/x", "example.org/es/", "block"),
            ("http://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"),
            ("http://a.org", "a.org", "", None, "allow"), ("x://b.org/", "b.org", "/", "org/", "allow"),
            ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), (None, "", "", None, "allow"),
            ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
            ("http://c.com/fr/", "c.com", "/fr/", "com/fr/", "allow"), ("http://c.com/de/?", "c.com", "/de/", "com/de/", "block"),
            ("http://É.net\n/a", "É.net\n", "/a", None, "allow")]
    pages = spark.createDataFrame([(i, r[0], "h", 1) for i, r in enumerate(rows)], "page_id bigint, url string, host string, bound int")
    labels = spark.createDataFrame([(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_pages(pages, known).collect()}
        assert got == {i: r[1:] for i, r in enumerate(rows)}
    assert urls.judge_pages(pages.limit(0), labels).count() == 0


def test_bad_hosts_are_blocked(spark):
    hosts = ["good.net"] * 300 + ["bad.net"] * 300 + ["few.net"] * 2 + ["new.net"] * 3
    pages = spark.createDataFrame([(i, f"http://www.{h}/{i}") for i, h in enumerate(hosts)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i % 20 > 0) if h == "good.net" else 0, 0) for i, h in enumerate(hosts) if h != "new.net"],
                                   "doc_id bigint, quality int, toxic int")
    got = urls.judge_pages(pages, labels)
    by = {(urls_host, verdict) for urls_host, verdict in got.select("host", "verdict").distinct().collect()}
    assert {v for h, v in by if h == "www.bad.net"} == {"block"} and {v for h, v in by if h == "www.good.net"} == {"allow"}
    assert {v for h, v in by if h == "www.new.net"} == {"allow"}


# 10

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, rest = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while rest and left > 1e-9:
        total = sum(weight[s] for s in rest)
        over = {s for s in rest if left * weight[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in rest}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        rest -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i:02}": int(rng.integers(0, 10 ** rng.integers(1, 5))) for i in range(11)} | {None: 50, "Z": 7, "é": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes), abs=1e-6)


def test_mixing(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(["w"] * int(rng.integers(0, 30))) for _ in range(3000)] + ODD
    sources = [["a", "b", "c", None][int(rng.integers(0, 4))] for _ in texts]
    docs = frame(spark, texts, sources)
    got = mixing.taken_words(docs).collect()
    assert Counter(got) == Counter(mixing.taken_words(docs.repartition(5)).collect())
    taken, targets = Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        source = sources[r.doc_id] if r.doc_id else "s"
        taken[source] += r.taken
        targets[source] = r.target
    for source, words in taken.items():
        if source != "s":
            assert abs(words - targets[source]) < 0.1 * targets[source] + 100
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))).first()[0]
    assert words >= 0.9 * sum(r.taken for r in got)
    assert mixing.taken_words(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_shingles():
    texts = pa.array(["A b  c\nd e f", None, "", "a b", "a b c d e f a b c d e", "x" * 400 + " y z"])
    got = shingles.shingles(texts)
    assert [len(h) for h, _ in got] == [2, 0, 0, 1, 6, 1] and got[4][1].sum() == 7
    assert set(got[0][0]) <= set(got[4][0])
