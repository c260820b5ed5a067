import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import quality

from .helpers import awkward, documents, prose, words
from .test_jaccard import brute


def plain(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + j for i, x in enumerate(tri) if n[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x0b\x1c", max_size=60))
def test_base_counts(text):
    assert quality.base_stats(text) == plain(text)


def test_verdicts(spark):
    rng = random.Random(2)
    texts = awkward()
    clean = [prose(rng, 80) for _ in range(30)]
    copy = prose(rng, 200).replace(". ", ".\n")
    notice = "\n".join(f"This notice line number {i} is repeated on all pages of this host for you" for i in range(8))
    shared = [prose(rng, 12) + "\n" + "\n".join(rng.sample(notice.split("\n"), 8)) + "\n" + prose(rng, 12) for _ in range(40)]
    every = texts + clean + [copy] * 50 + shared
    docs = documents(spark, every, ["h"] * len(every), extra=True)
    got = {r["doc_id"]: r for r in quality.verdicts(docs).collect()}
    assert len(got) == len(every)
    for i, t in enumerate(every):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain(t)
        n, *_, repeated = plain(t)
        assert got[i]["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
    first = len(texts)
    assert all(got[i]["kept"] for i in range(first, first + 30 + 50)), "clean documents and copies stay"
    assert not any(got[i]["kept"] for i in range(first + 80, len(every))), "documents of boilerplate go"
    kept = quality.keep_clean(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}
    twice = quality.verdicts(docs.union(docs)).collect()
    assert len(twice) == 2 * len(every)
    assert quality.verdicts(docs.limit(0)).count() == 0


def normal(line):
    return " ".join(words(line.lower()))


def test_verdicts_equal_plain_counts(spark):
    """removed_words and kept against plain counting, with blocks in fixed order, refrains, copies and several hosts."""
    rng = random.Random(14)
    blocks = ["\n".join(prose(rng, 12) for _ in range(b + 3)) for b in range(4)]
    texts, hosts = list(awkward()), []
    for i in range(520):
        parts = [prose(rng, rng.randrange(2, 60 if i % 3 else 8)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(blocks))
        if i % 5 == 0:
            parts += ["la la the refrain"] * 30
        texts.append("\n".join(parts))
    song = [prose(rng, 11) for _ in range(30)]
    edited = []
    for _ in range(120):  # near copies, each with a few lines of its own
        copy = list(song)
        for k in rng.sample(range(30), rng.choice([1, 2, 3, 14])):  # some are depleted, some aren't
            copy[k] += " own" + str(rng.randrange(10**6))
        edited.append("\n".join(copy))
    texts += [texts[40]] * 50 + edited + [texts[41].upper().replace(" ", "\t")] * 30
    hosts = [rng.choice(["a", "b", None]) for _ in texts]
    lines = [[normal(x) for x in (t or "").split("\n") if words(x)] for t in texts]

    def common(document):
        n = Counter((h, x) for h, d, x in {(hosts[i], document(i), x) for i, d in enumerate(lines) for x in d})
        return {key for key, count in n.items() if count > quality.LINE_LIMIT}

    def gone(i, found):
        return sum(len(x.split(" ")) for x in lines[i] if (hosts[i], x) in found)

    def depleted(i, found):
        total = plain(texts[i])[0]
        return total - gone(i, found) < quality.LEFT_SHARE * total

    first = common(lambda i: tuple(lines[i]))
    failed = [(p := plain(t))[0] < 50 or 100 * p[4] > 50 * p[0] for t in texts]
    some = [i for i in range(len(texts)) if not failed[i] and depleted(i, first)]
    doubtful = {(hosts[i], x) for i in some for x in lines[i]} & first
    holders = [i for i, d in enumerate(lines) if any((hosts[i], x) in doubtful for x in d)]
    roots, _ = brute([texts[i] for i in holders], 80, 5)
    classes = {i: ("class", holders[r]) for i, r in zip(holders, roots, strict=True)}
    found = common(lambda i: classes.get(i, tuple(lines[i])))
    assert some and found < first, "near copies make no line common"
    docs = documents(spark, texts, hosts)
    docs = docs.union(docs.where("doc_id > 200"))  # repeated rows
    got = quality.verdicts(docs).collect()
    assert len(got) == docs.count() and any(r["removed_words"] for r in got) and not all(r["kept"] or r["base_failed"] for r in got)
    for r in got:
        i = r["doc_id"]
        assert r["removed_words"] == gone(i, found)
        assert r["kept"] == (not failed[i] and not depleted(i, found))
    assert all(r["kept"] for r in got if texts[r["doc_id"]] in edited), "edited copies stay for the join"
    named = docs.withColumns({"_text": F.lit("mine"), "__text": F.lit("too")})
    kept = quality.keep_clean(named)
    assert kept.columns == named.columns and {(r["_text"], r["__text"]) for r in kept.collect()} == {("mine", "too")}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])


def test_null_host(spark):
    docs = spark.createDataFrame([(1, "a " * 60, None), (None, None, None)], "doc_id long, text string, source string")
    assert quality.verdicts(docs).count() == 2


def test_lines_count_documents(spark):
    rng = random.Random(6)
    notice = "\n".join(f"This licence line number {i} stands in the same order on all pages of this host" for i in range(8))
    shared = [prose(rng, 12) + "\n" + notice + "\n" + prose(rng, 12) for _ in range(21)]
    # A refrain of one document between ever new neighbours, and twenty documents only with another notice.
    refrain = "\n".join(f"the refrain of this one song is here once more\nv{i}" for i in range(30))
    few = [prose(rng, 3) + "\n" + notice.replace("licence", "colophon") for _ in range(20)]
    copies = [notice.replace("licence", "imprint")] * 30 + [notice.replace("licence", "IMPRINT").replace(" ", "  ")]
    every = shared + [refrain] + few + copies
    got = {r["doc_id"]: r for r in quality.verdicts(documents(spark, every, ["h"] * len(every))).collect()}
    assert [got[i]["removed_words"] for i in range(21)] == [len(notice.split())] * 21
    assert not any(got[i]["kept"] for i in range(21))
    assert all(got[i]["removed_words"] == 0 for i in range(21, len(every)))
    lines = quality.common_lines(quality.document_lines(documents(spark, every, ["h"] * len(every))))
    assert [r["n_documents"] for r in lines.collect()] == [21] * 8
