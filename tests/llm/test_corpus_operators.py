"""Operators across rows: decontamination, packing, chat windows, n-gram groups, the pipeline."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import automaton, chat, decontaminate, jaccard, packing, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words5(t):
    t = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_hits(text, items):
    w = words5(text)
    hit, found = set(), set()
    for name, item in items:
        v = words5(item)
        n = min(13, len(v))
        if not n:
            continue
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add("null" if name is None else str(name))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "A", "b"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(None, "one two three"), (1, None), (2, "  "), (3, "w1"), (4, "w2 w3"), (10, "w5 w5 w5 w5"), *((20 + i, line(rng.randrange(5, 40))) for i in range(12)), (50, line(20)), (50, line(9))]
    texts = [None, "", "...", "ONE, two; three!", *(line(rng.randrange(60)) for _ in range(60))]
    for name, item in items:
        if item and len(words5(item)) > 4:
            v = item.split()
            a = rng.randrange(len(v))
            texts.append(f"{line(5)}, {' '.join(v[a : a + 16])}. {line(5)}")
            texts.append(item.upper() + " " + item)
    texts += [texts[-1]] * 3 + [" ".join([line(3000), items[-3][1], line(3000)])]
    df, bench = docs(spark, texts).withColumn("n_hit", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 300):  # in one pass, and in several
        out = decontaminate.find_passages(df, bench, block_bytes=block)
        for r in out.collect():
            assert (r["n_words"], r["n_hit"], r["hit_items"]) == brute_hits(r["text"], items)
            assert sum(s["end"] - s["start"] for s in r["hit_spans"]) == r["n_hit"]
        assert out.count() == len(texts)
    assert decontaminate.find_passages(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_passages(df.limit(0), bench).count() == 0


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(left, b) for b, (left, s, c) in enumerate(bins) if left >= sizes[i] and (sources[i] is None or sources[i] not in s) and (clusters[i] is None or clusters[i] not in c)]
        if not fits:
            bins.append([capacity, set(), set()])
            fits = [(capacity, len(bins) - 1)]
        b = min(fits)[1]
        bins[b][0] -= sizes[i]
        bins[b][1].add(sources[i])
        bins[b][2].add(clusters[i])
        out[i] = b
    return out


def test_packing(spark):
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randrange(1, 120)
        sizes = [rng.randrange(0, 101) for _ in range(n)]
        sources = [rng.choice([None, "hot", "hot", *"abcdefg"]) for _ in range(n)]
        clusters = [rng.choice([None, *range(40)]) for _ in range(n)]
        got = packing.best_fit(sizes, sources, clusters, 100)
        want = plain_best_fit(sizes, sources, clusters, 100)
        left = lambda bins: sorted(sum(s for s, b in zip(sizes, bins) if b == x) for x in set(bins))
        assert left([b for b, _ in got]) == left(want)
    rows = [(i, rng.choice([None, 0, 5, 99, 100, 101, 250]), rng.choice([None, "hot", "a", "b"]), rng.choice([None, "c1", "c2"])) for i in range(500)] * 2
    df = spark.createDataFrame(rows, "k long, n long, s string, c string")
    out = packing.pack(df.withColumn("bin", F.lit("clash")), "k", "n", "s", "c", 100, group_rows=200)
    facts = {r[0]: (r[2], r[3]) for r in rows}
    bins = {}
    for r in out.collect():
        assert r["n_full"] * 100 + r["rest"] == r["size"] and 0 <= r["rest"] <= 100
        bins.setdefault((r["group"], r["bin"]), []).append(r)
    for held in bins.values():
        assert sum(r["rest"] for r in held) <= 100 and sorted(r["place"] for r in held) == list(range(len(held)))
        for i in (0, 1):
            marks = [facts[r["k"]][i] for r in held if facts[r["k"]][i] is not None]
            assert len(marks) == len(set(marks))
    assert sum(map(len, bins.values())) == 1000 and len({g for g, _ in bins}) == 5
    assert packing.pack(df.limit(0), "k", "n", "s", "c", 100).count() == 0


def test_chat(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<|", "|<\\", "a\\n\nb", "", "é😀", None]
    for t in nasty:
        if t is not None:
            assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t) and chat.unescape_role(chat.escape_role(t)) == t
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "as\nsis\\tant", None]) if t else "system", rng.choice([*nasty, "word " * rng.randrange(400)])) for c in (1, 2, 3, None) for t in range(rng.randrange(1, 40))]
    rows += [(9, None, "user", "x"), (9, 1, "assistant", "long " * 5000), (9, 1, "assistant", "long " * 5000), (-1, 0, "user", nasty[0]), (-1, 1, "assistant", nasty[0])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat.format_conversations(df, budget=300, history_tokens=100)
    digests = {r["conv_id"]: r for r in chat.conversation_digests(windows).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert digests.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for *_, r, x in turns if r == "assistant")
        assert digests[c]["n_turns"] == len(turns) and digests[c]["loss_chars"] == len(said)
        assert digests[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert digests[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    for w in windows.collect():
        turns = chat.parse(w["formatted"])
        assert w["tokens"] <= 300 or len(turns) - w["repeated"] == 1
        if w["window"] and w["conv_id"] in (1, 2, 3):
            assert turns[0][0] == "system" and w["repeated"] >= 1
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def brute_groups(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng):
    vocabulary = [f"w{i}" for i in range(200)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A\tB c\nd", "a b c d e"]
    for _ in range(40):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 15, 30, 80, 200, 700]))]
        if rng.random() < 0.4:
            own += passage
        texts.append(" ".join(own))
        for _ in range(rng.randrange(5)):
            for _ in range(rng.randrange(1 + len(own) // 25)):
                at = rng.randrange(len(own))
                if rng.random() < 0.5:
                    own[at] = rng.choice(vocabulary)
                else:
                    own.insert(at, rng.choice(vocabulary))
            texts.append(" ".join(own).upper() if rng.random() < 0.1 else " ".join(own))
    return texts


def test_groups(spark):
    for seed, (k, num, den) in enumerate([(4, 85, 100), (5, 80, 100)]):
        texts = near_copies(random.Random(seed))
        df = docs(spark, texts).withColumn("cls", F.lit("clash"))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.ngram_groups(df, k=k, num=num, den=den).collect()}
        want = brute_groups(texts, k, num, den)
        assert [got[i] for i in range(len(texts))] == want
        assert len({c for _, c in want}) < len(texts) - 20
    repeated = jaccard.ngram_groups(df.union(df.limit(10)))
    assert repeated.count() == len(texts) + 10
    assert jaccard.ngram_groups(df.limit(0)).count() == 0


def test_every_link_shares_a_block():
    """Pairs at the very bound, of many sizes: filed under a common entry."""
    import numpy as np

    rng = np.random.default_rng(2)
    for num, den in ((85, 100), (80, 100)):
        bound = jaccard.Bound(num, den)
        for n in [*range(1, 60), 100, 333, 1000, 5000]:
            own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            for _ in range(4):
                gone = int(rng.integers(0, n))
                while gone and den * (n - gone) < num * n:
                    gone //= 2
                more = 0
                while den * (n - gone) >= num * (n + more + 1):
                    more += 1
                other = np.unique(np.concatenate([rng.permutation(own)[gone:], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
                if gone or more:
                    assert set(jaccard.entries(own, bound).tolist()) & set(jaccard.entries(other, bound).tolist())


def test_tree():
    import numpy as np

    rng = np.random.default_rng(4)
    own = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(own)[: 400 - d], rng.integers(0, 1 << 63, d, dtype=np.uint64)])) for d in rng.integers(0, 60, 600)]
    points, sizes, bound = jaccard.same_space([jaccard.point(s) for s in sets]), np.array([len(s) for s in sets]), jaccard.Bound(85, 100)
    tree = jaccard.CountTree(points, sizes)
    for i in range(0, 599, 37):
        want = i + 1 + np.flatnonzero(jaccard.allowed(points[i + 1 :], sizes[i + 1 :], points[i], int(sizes[i]), bound))
        assert sorted(tree.search(i, bound, np.arange(len(sizes))).tolist()) == want.tolist()
        for j in range(i + 1, 600):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
                assert j in want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    name = lambda i: i.to_bytes(4, "big")
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges if a != b], "a binary, b binary")
    got = {int.from_bytes(r["cls"], "big"): int.from_bytes(r["label"], "big") for r in jaccard.components(df).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_automaton():
    rng = random.Random(2)
    patterns = ["ab+c?", "(a|bc){2,3}d", "[^a-c\\n]x", "a.c", "\\x41\\d{2,}", "(?:ab|a)b"]
    for fold in (False, True):
        both = automaton.Automaton([(p, fold) for p in patterns], search=True)
        for k, p in enumerate(patterns):
            own = automaton.Automaton([(p, fold)], search=False)
            for _ in range(300):
                text = "".join(rng.choice("abcdxA12\n") for _ in range(rng.randrange(10)))
                flags = re.I if fold else 0
                data, s, seen = text.encode().translate(both.classes), 0, set()
                for c in data:
                    s = both.table[s][c]
                    seen |= both.accepts[s]
                assert (k in seen) == bool(re.search(p, text, flags))
                ends = [e for e in range(1, len(text) + 1) if re.fullmatch(p, text[:e], flags)]
                assert own.longest(text.encode().translate(own.classes), 0) == (max(ends) if ends else -1)


def test_pipeline(spark):
    import corpus_pipeline

    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    rows = {r["doc_id"]: r["text"] for r in table("documents").collect()}
    index = toxicity.train(table("documents"), table("labels"))
    kept = [i for i in sorted(rows) if index.score(toxicity.term_counts((rows[i] or "").encode()))[0] < 0.5]
    groups = brute_groups([rows[i] for i in kept], 5, 80, 100)
    kept = [i for at, i in enumerate(kept) if groups[at][1] == at]
    items = [(r["item_id"], r["text"]) for r in table("benchmark").collect()]
    clean = []
    for i in kept:
        n, hit, _ = brute_hits(rows[i], items)
        if not (hit and 20 * hit >= n):
            clean.append(i)
    docs_ = table("documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = corpus_pipeline.stored(stage(spark, docs_, SF), name)
        assert docs_.columns == table("documents").columns
    assert sorted(r["doc_id"] for r in docs_.select("doc_id").collect()) == clean
    for r in docs_.collect():
        raw = rows[r["doc_id"]].encode()
        assert r["text"] == secrets.redacted(raw, [(a, b) for a, b, _ in secrets.scanner().spans(raw)], "[secret]")
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == clean
    # Odd rows: nulls, empty texts, repeated rows.
    odd = table("documents").limit(30)
    odd = odd.union(odd.limit(5)).union(spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (7_000_000, "", None, None, 0)], odd.schema))
    for name, stage in corpus_pipeline.STAGES:
        odd = corpus_pipeline.stored(stage(spark, odd, SF), name)
    assert odd.where("doc_id = 7000000").count() == 1
    empty = table("documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.stored(stage(spark, empty, SF), name)
    assert empty.count() == 0


def test_components_merged(spark):
    name = lambda pairs: spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in pairs], "a binary, b binary")
    first, more = [(1, 2), (2, 3), (4, 5), (6, 7), (8, 9)], [(3, 5), (7, 20), (21, 22), (5, 6)]
    rows = lambda df: sorted((r["cls"][0], r["label"][0]) for r in df.collect())
    got = rows(jaccard.merged(jaccard.components(name(first)), name(more)))
    assert got == rows(jaccard.components(name(first + more)))


def test_groups_of_a_null_key(spark):
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["x"] + base[31:]
    rows = [(None, " ".join(near)), (4, " ".join(base)), (9, " ".join(base)), (7, None), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.ngram_groups(df).orderBy("doc_id", "n_shingles").collect()
    assert [tuple(r) for r in got] == [(None, 1, None), (None, 57, 4), (4, 57, 4), (7, 0, 7), (9, 57, 4)]


def test_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    text = lambda w: " ".join(f"{w}{i}" for i in range(80))
    near = lambda w: text(w) + " more"
    rows = [(1, text("a")), (2, near("a")), (2, text("b")), (3, text("c")), (3, near("c")), (None, text("d")), (None, near("d")), (None, near("b")), (None, text("e")), (4, text("f")), (4, text("f")), (5, ""), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.jaccard_stage(spark, df, SF).collect()]
    assert [i for i, t in left if t.startswith("a")] == [1] and [i for i, t in left if t.startswith("b")] == [2]
    assert [i for i, t in left if t.startswith("c")] == [3] and [i for i, t in left if t.startswith("d")] == [None]
    assert (None, text("e")) in left and left.count((4, text("f"))) == 1 and left.count((5, "")) == 2 and len(left) == 8


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n)), "".join("ba"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_polynomials_modulo_powers_of_two_confuse(spark):
    x, y = thue_morse(1024)
    df = docs(spark, [f"one two three {w} five six" for w in (x, y)])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.ngram_groups(df, num=60).collect()}
    assert got == {0: 0, 1: 1}
    items = spark.createDataFrame([("i", f"one two three {x} five six")], "item_id string, text string")
    assert [r["n_hit"] for r in decontaminate.find_passages(df, items).orderBy("doc_id").collect()] == [6, 0]


def test_large_leaves_in_parts(spark, monkeypatch):
    """A large group of near copies, and one of texts that share half: every part meets every other."""
    monkeypatch.setattr(jaccard, "PART", 7)
    rng = random.Random(8)
    base, other = [[f"{c}{i}" for i in range(120)] for c in "vw"]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(own))
    for i in range(40):
        texts.append(" ".join(other[:90] + [f"y{i // 2}{j}" for j in range(60)] + [f"z{i}"]))
    rng.shuffle(texts)
    for k, num, den in ((4, 85, 100), (5, 80, 100)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.ngram_groups(docs(spark, texts), k=k, num=num, den=den).collect()}
        assert [got[i] for i in range(len(texts))] == brute_groups(texts, k, num, den)


def test_shared_shingles():
    rng = random.Random(3)
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    for _ in range(300):
        k = rng.choice([1, 2, 4, 5])
        a, b = ([rng.choice("abc").encode() for _ in range(rng.randrange(1, 12))] for _ in range(2))
        x, y = grams(a, k), grams(b, k)
        assert jaccard.shared(b" ".join(a), b" ".join(b), k) == (len(x), len(y), len(x & y))


def test_pipeline_with_clashing_columns_and_rows_that_repeat(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a), (5, b), (None, a), (8, ""), (8, ""), (9, None)]
    names = "score n_words n_hit hit_items hit_spans secret_spans evidence cls label n_shingles component_id text_hash Score_ key".split()
    df = spark.createDataFrame([(i, t, "en", f"s{n}", len(t or ""), *(f"{c}{n}" for c in names)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, df, SF)
        assert left.schema.names == df.schema.names and [f.dataType for f in left.schema] == [f.dataType for f in df.schema]
        for r in left.collect():
            assert len({r[c][len(c) :] for c in names} | {r["source"][1:]}) == 1
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.jaccard_stage(spark, df, SF).collect()]
    assert sorted(left, key=repr) == sorted([(1, a), (5, b), (8, ""), (8, ""), (9, None)], key=repr)
    assert corpus_pipeline.packing_stage(spark, df, SF).count() == len(rows)


def test_members_of_many_leaves_are_looked_at_again_once(spark, monkeypatch):
    """Near copies share many leaves: what the first searches leave open has a row for each class, and no search joins its rows twice."""
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        own = [f"v{i}" for i in range(150)]
        for at in rng.sample(range(150), rng.randrange(2, 6)):
            own[at] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(own))
    searches, search = [], jaccard._pairs_of

    def counted(rows, points, bound, whole):
        searches.append((whole, rows.count(), "Join" in rows._jdf.queryExecution().toString()))
        return search(rows, points, bound, whole)

    monkeypatch.setattr(jaccard, "_pairs_of", counted)
    want = brute_groups(texts, 4, 85, 100)
    assert len({c for _, c in want}) > 2
    for parts in (8, 0):  # 0: by leaves
        monkeypatch.setattr(jaccard, "PARTS", parts, raising=False)
        searches.clear()
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.ngram_groups(docs(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want
        assert [whole for whole, _, _ in searches] == [False, True] and not any(joins for _, _, joins in searches)
        assert (searches[1][1] <= len(texts)) == (parts > 0)
