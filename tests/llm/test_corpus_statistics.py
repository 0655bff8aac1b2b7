"""Class model, source audit and token alignment against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import class_lm, lexicon, source_audit, token_alignment
from tests.llm import brute
from tests.llm.test_operators import DIR, ROWS, SCHEMA

SMALL = 4000  # few enough for whole-text tokenizing in a test


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, a row without an id, and extra columns of clashing names."""
    d = spark.createDataFrame(ROWS, SCHEMA).union(spark.createDataFrame([(None, "no id but words", "en", "a", 1)], SCHEMA))
    for c in ("row", "word", "n", "pairs", "times", "term", "i", "docs", "rest", "key", "rank", "value"):
        d = d.withColumn(c, F.lit(7))
    return d


# helpers


def test_pieces_join_to_the_text_and_cut_at_gaps():
    r = random.Random(2)
    for _ in range(300):
        t = bytes(r.choice(b"ab \n") for _ in range(r.randrange(60)))
        p = list(lexicon.text_pieces(t, class_lm.GAP, 7))
        assert b"".join(p) == t
        assert [w for x in p for w in x.split()] == t.split()


def test_most_frequent_keeps_its_limit(spark):
    d = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 20 + [900, 1000, 5000, 100_000])], "i int, n long")
    for limit, want in ((3, 3), (10, 4), (24, 24), (25, 24), (74, 74), (0, 0)):
        assert d.where(lexicon.most_frequent(d, F.col("n"), limit)).count() == want


# class model


def objective(t):
    x = lambda a: sum(v * math.log(v) for v in a.ravel() if v > 0)
    return x(t) - x(t.sum(1)) - x(t.sum(0))


def test_best_class_is_the_best_of_all_by_recounting():
    r = random.Random(3)
    for _ in range(60):
        k, n = 4, 12
        of = np.array([r.randrange(k) for _ in range(n)] + [k, k + 1])
        seq = [r.randrange(n + 2) for _ in range(80)]

        def counted(c, seq=seq, k=k):
            t = np.zeros((k + 2, k + 2))
            for a, b in zip(seq, seq[1:], strict=False):
                t[c[a], c[b]] += 1
            return t

        w, after, before, itself = r.randrange(n), np.zeros(k + 2), np.zeros(k + 2), 0
        for a, b in zip(seq, seq[1:], strict=False):
            after[of[b]] += a == w
            before[of[a]] += b == w
            itself += a == b == w
        values = []
        for c in range(k):
            other = of.copy()
            other[w] = c
            values.append(objective(counted(other)))
        got = class_lm.best_class(counted(of), int(of[w]), after, before, itself, k)
        assert values[got] >= max(values) - 1e-6 and values[got] >= values[of[w]]


def plain_scores(rows, m, counts):
    """(doc_id, held_out, n_tokens, n_known, base, score) with every word looked up."""
    number = {w: i for i, w in enumerate(m.words)}
    rare, end, out = len(number), len(number) + 1, []
    bottom = m.train_tokens + m.n_words + 1
    for doc_id, text in rows:
        words = [w.translate(brute.LOW) for w in brute.words(text)]
        base = score = known = 0
        last = end
        for w in [*words, ""]:
            c, i = counts.get(w, 0), number.get(w.encode(), rare) if w else end
            base += math.log10((c + 1) / bottom)
            known += c > 0
            score += m.transition[m.of_word[last], m.of_word[i]] + m.emission[i]
            if i == rare:
                score += math.log10((c or m.rare_once + 1) / (m.rare_tokens + m.rare_once + 1))
            last = i
        out.append((doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2, len(words) + 1, known, base, score))
    return out


def plain_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            n.update(w.translate(brute.LOW) for w in brute.words(text))
            n[""] += 1
    return n


def same_scores(got, want):
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)


@pytest.mark.parametrize("which", ["odd", "documents", "few words"])
def test_scores_equal_plain_ones(spark, odd, which):
    docs = odd if which == "odd" else spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    settings = {"words": 300 if which == "few words" else 1 << 16, "classes": 8, "rounds": 2, "looked_up": 700 if which == "few words" else 1 << 17}
    model, counts = class_lm.learn(docs.select("doc_id", "text"), **settings)
    want = plain_counts(rows)
    assert {r.word: r.n for r in counts.collect()} == want
    assert (model.train_tokens, model.n_words) == (sum(want.values()), len(want))
    assert len(model.words) <= settings["looked_up"] and model.clustered == min(settings["words"], len(model.words)) and all(want[w.decode()] >= class_lm.LEAST for w in model.words)
    out = class_lm.score(docs, **settings).collect()
    assert {r.train_tokens for r in out} == {sum(want.values())}
    same_scores([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in out], plain_scores(rows, model, want))


def test_probabilities_add_up_and_texts_beat_the_base(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    m, counts = class_lm.learn(docs.select("doc_id", "text"), words=500, classes=8, rounds=2, looked_up=900)
    n = {r.word: r.n for r in counts.collect()}
    own, seen = set(m.words[: m.clustered]), set(m.words)
    assert m.clustered == 500 < len(seen)
    assert sum(v for w, v in n.items() if w and w.encode() not in own) == m.rare_tokens
    emitted = np.zeros(10)
    np.add.at(emitted, m.of_word[: len(m.words)], 10 ** m.emission[: len(m.words)])
    assert emitted[:8][np.unique(m.of_word[:500])] == pytest.approx(1)
    others = sum(v for w, v in n.items() if w and w.encode() not in seen)
    assert emitted[8] + (others + m.rare_once + 1) / (m.rare_tokens + m.rare_once + 1) == pytest.approx(1)
    assert (10**m.transition).sum(1) == pytest.approx(1)
    out = class_lm.score(docs, words=500, classes=8, rounds=2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_exchange_raises_the_objective_and_parts_languages(spark):
    """Two languages that never mix, each with words of two places: a class holds words of one language, and none is better off elsewhere."""
    r = random.Random(4)
    word = lambda x: f"{x}{r.randrange(8)}"
    rows = [(i, " ".join(word(x) for _ in range(40) for x in ("ab" if i % 2 else "cd"))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, _ = class_lm.learn(docs, classes=8, rounds=0)
    last, _ = class_lm.learn(docs, classes=8, rounds=10)
    kinds = {}
    for w, c in zip(last.words, last.of_word, strict=False):
        kinds.setdefault(int(c), set()).add(w[:1] in b"ab")
    assert all(len(k) == 1 for k in kinds.values())
    total = [class_lm.score(docs, classes=8, rounds=n).agg(F.sum("score")).first()[0] for n in (0, 10)]
    assert total[1] > total[0] and first.words == last.words


def test_scores_of_nothing(spark):
    assert class_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = [(i, "x y") for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    out = class_lm.score(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out] == [(3, 0, 0, 0.0)] * 3


# source audit


def audited(spark, docs, tmp_path, min_docs=2):
    docs.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/d")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = c.sql(source_audit.OP12_SQL.replace(">= 10)", f">= {min_docs})")).df()
    got = source_audit.audit(docs, min_docs).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)
    return got


def test_audit_equals_sql_on_awkward_rows(spark, odd, tmp_path):
    got = audited(spark, odd, tmp_path, 1)
    assert set(got.part) == {"pair", "term"} and "" in set(got.source)


def test_audit_with_ties_repeats_and_long_lists(spark, tmp_path):
    """More sources than a block of postings has, equal counts, and a term that all of them have."""
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["Ab", "ab", "É", "ü-ß", "x1y", "common"]) for _ in range(r.randrange(6))), "en", f"s{i % 90}") for i in range(400)]
    rows += [(1, "ab", "fr", "only"), (1, "ab", "fr", "only"), (2, None, None, None)]
    audited(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), tmp_path)


def test_audit_of_nothing(spark):
    assert source_audit.audit(spark.createDataFrame([], SCHEMA)).count() == 0


# token alignment


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner(token_alignment.VOCABULARIES)


def whole(al, text):
    """n_a, n_b, n_groups, n_links, groups and links of a text encoded whole."""
    none = (0, 0, 0, 0, "", Counter())
    if not text:
        return none
    a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    ends_a, ends_b = (np.cumsum([len(t[i]) for i in x]).tolist() for t, x in ((al.a_bytes, a), (al.b_bytes, b)))
    if not b"".join(al.a_bytes[i] for i in a) == b"".join(al.b_bytes[i] for i in b) == (" " + text).encode():
        return none
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    links = Counter((p, q) for x, y in groups for p in x for q in y)
    said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    return len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest(), links


def plain_alignment(al, rows):
    each = [(i, whole(al, t)) for i, t in rows]
    held = Counter(p for _, x in each for p in x[5])
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return [(i, *x[:4], sum(n for p, n in x[5].items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in x[5].items()), x[4]) for i, x in each]


def test_union_find_on_chains_stars_and_loops():
    r = random.Random(7)
    for _ in range(100):
        n = r.randrange(1, 60)
        e = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(80))] + [(i, i + 1) for i in range(n // 2)]
        u = brute.Union(range(n))
        for a, b in e:
            u.join(a, b)
        got = token_alignment.union_find(n, *np.array(e or np.zeros((0, 2), int)).T)
        assert got.tolist() == [u.find(i) for i in range(n)]


def test_chunks_align_like_whole_texts(aligner):
    """Random texts of spaces, marks, scripts, special tokens and white space of all kinds, in batches that share chunks."""
    import pyarrow as pa

    r = random.Random(8)
    parts = list("ab  cdé\n\t»«'’., 　 \x85\x1c漢字🎉1２²ﬁ|กำ​▁") + ["<|endoftext|>", "<s>", "</s>", "<0x41>", "  ", "\n \n", "the", " and", "'s"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 50))) for _ in range(1500)] + [" ", "  ", " a", "a ", "a  ", "\n ", " \n", "x" * 3000, " " * 300, "=" * 999, None, ""]
    al = token_alignment.Aligner(token_alignment.VOCABULARIES)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        out = token_alignment._aligned(al, pa.array(range(len(some))), some, 0).to_pydict()
        for k, t in enumerate(some):
            w = whole(aligner, t)
            assert (out["n_a"][k], out["n_b"][k], out["n_groups"][k], out["n_links"][k], out["groups_sha256"][k]) == w[:5], repr(t)
            assert dict(zip(out["pairs"][k], out["times"][k], strict=True)) == {p << 15 | q: n for (p, q), n in w[5].items()}


@pytest.mark.parametrize("hot", [token_alignment.HOT, 40, 0])
def test_alignment_equals_plain_one(spark, odd, aligner, hot):
    docs = odd.select(*odd.columns).union(odd.where("doc_id = 8")).withColumn("text", F.expr(f"case when length(text) > {SMALL} then concat(left(text, {SMALL}), ' ') else text end"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = token_alignment.align(docs, hot_pairs=hot).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == sorted(map(repr, plain_alignment(aligner, rows)))


def test_alignment_of_the_smallest_table(spark, aligner):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = [tuple(r[c] for c in names) for r in token_alignment.op13_token_alignment(spark, DIR).collect()]
    assert sorted(got) == sorted(plain_alignment(aligner, rows))
    assert token_alignment.align(docs.limit(0)).count() == 0
