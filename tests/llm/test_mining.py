"""Resampling, line runs and phrase tiles against plain loops, on small and awkward inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from canlake.llm import line_runs, phrases, resampling
from canlake.llm.common import reach_workers
from canlake.llm.line_runs import LineRuns, deduplicated, keyed_lines, with_kept_lines

#: Columns besides those read carry names that the operators use themselves.
EXTRA = "key string, row string, row_key long, first long, batch int, n long, place long, text_ string"
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"
EXTRAS = ("k", "r", 7, 8, 9, 10, 11, "t")


def frame(spark, rows):
    reach_workers(spark)
    return spark.createDataFrame([(*row, *EXTRAS) for row in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 4))) for _ in range(25)]
    lines = [" ".join(rng.choice(words, 5)) for _ in range(30)]
    texts = [None, "", " ", "\n", "\n\n", "A b C", "x", "É é Éa", "tail\n", "\x0b A  B\t\n\r", "a1 2b,c;d!e", "\x00\x1f\x7f", "日本 語　x", "1e5 -- __ ``"]
    for i in range(60):
        picked = [lines[int(rng.integers(0, 30))] for _ in range(int(rng.integers(1, 8)))]
        picked += [f"  {picked[0].upper()}\t", "short", "short", "", f"own line {i} {' '.join(rng.choice(words, 12))}"]
        texts.append("\n".join(picked) + (". " if i % 3 else "; ") + " ".join(rng.choice(words, 40)))
    texts += ["\n".join([lines[0]] * 5), lines[0], " ".join(rng.choice(words, 60_000)), texts[20], texts[21]]
    langs = ["en", "en", "fr", None, "und"]
    out = [(i, t, langs[i % 5], "s") for i, t in enumerate(texts)]
    out += [out[30], out[30], (25, lines[1] + "\nanother text of one id", "en", "s"), (None, lines[2] + "\nno id at all, twice", "fr", "s"), (None, lines[2], "fr", None)]
    return out


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# resampling


def plain_resampling(rows, target, width, buckets, percent, least_words, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        runs = [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    found = [(r[0], *features(r[1])) for r in rows]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for text in target for b in features(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for doc, words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranked = Counter((*r, i + 1) for i, r in enumerate(may[: len(may) * percent // 100]))
    return out, ranked


@pytest.mark.parametrize("width, buckets, percent, least_words", [(1, 10_000, 10, 20), (3, 50, 40, 2)])
def test_resampling_equals_plain_loops(spark, rows, width, buckets, percent, least_words):
    target = ["a b c", None, "", rows[20][1], "É é"]
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resampled(frame(spark, rows).repartition(3), texts, width, buckets, percent, least_words).collect()
    want, ranked = plain_resampling(rows, target, width, buckets, percent, least_words, 2024)
    fields = ("doc_id", "n_words", "n_features", "weight", "score")
    assert Counter(tuple(r[f] for f in fields) for r in found) == Counter(want)
    drawn = Counter((*(r[f] for f in fields), r["rank"]) for r in found if r["rank"])
    assert sum(ranked.values()) > 0 and drawn == ranked


def test_features_do_not_depend_on_blocks():
    text = "The cat, the CAT; sat on é1 mats: " * 9
    whole = [h for part in resampling.feature_hashes(text.encode(), 3) for h in part]
    for size in (1, 7, 30):
        assert Counter(h for part in resampling.feature_hashes(text.encode(), 3, size) for h in part) == Counter(whole)


def test_drawn_documents_keep_their_columns(spark, rows):
    docs = frame(spark, rows)
    drawn = resampling.resampled_documents(docs, docs.select("text"), percent=50)
    assert drawn.schema == docs.schema
    eligible = [r for r in rows if len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(r[1]))) >= 20]
    got = [tuple(r) for r in drawn.collect()]
    assert len(got) == len(eligible) // 2 and not Counter(got) - Counter((*r, *EXTRAS) for r in eligible)


def test_resampling_of_empty_tables(spark, rows):
    none = frame(spark, [])
    assert resampling.resampled(none, none).count() == 0
    found = resampling.resampled(frame(spark, rows), none).collect()
    assert len(found) == len(rows)


# line runs


def plain_lines(rows, least=10):
    white = " \t\n\x0b\x0c\r"
    id_of = lambda doc: -(2**63) if doc is None else doc
    first = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(white))
            if len(key) >= least:
                first[key] = min(first.get(key, 2**63), id_of(doc))
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if first.get(lowered(line.strip(white)), id_of(doc)) == id_of(doc)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("batches, fanout", [(1, 3), (3, 2), (9, 2), (7, 3)])
def test_lines_equal_plain_loops(spark, rows, batches, fanout):
    found = with_kept_lines(frame(spark, rows).repartition(3), batches=batches, fanout=fanout).collect()
    want = plain_lines(rows)
    assert sum(r[3] for r in want) > 50
    assert Counter((r["row"]["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in found) == Counter(want)


def test_deduplicated_documents_keep_their_columns(spark, rows):
    docs = frame(spark, rows)
    found = deduplicated(docs)
    assert found.columns == docs.columns
    texts = {r: t for r, (_, t, _, _) in zip(range(len(rows)), plain_lines(rows))}
    want = Counter((r[0], None if r[1] is None else texts[i], *r[2:], *EXTRAS) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in found.collect()) == want


def test_runs_hold_every_key_once_and_are_compacted(spark, rows):
    store = LineRuns(spark, 4, fanout=2)
    cuts = list(range(10, 70, 10))
    for lines in keyed_lines(frame(spark, rows), cuts):
        store.add(lines)
        store.compact()
    assert len(cuts) == 6 and [len(level) for level in store.levels] == [1, 1, 1]  # seven batches: one, two and four
    held = [r["key"] for run in store.runs() for r in run.where("not known").select("key").collect()]
    keys = {lowered(line.strip(line_runs.WHITE)) for r in rows for line in (r[1] or "").split("\n")}
    assert len(held) == len(set(held)) == len([k for k in keys if len(k) >= 10])


def test_batches_do_not_shuffle_the_runs(spark, rows):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = LineRuns(spark, partitions)
    first, second = keyed_lines(frame(spark, rows), [40])
    store.add(first)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = store.runs()[0].where("not known").select("key")
        plan = second.groupBy("key").count().join(run, "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_lines_of_empty_tables(spark):
    assert with_kept_lines(frame(spark, [])).count() == 0
    assert spark.sql("SHOW TABLES").where("tableName like 'canlake_run%'").count() == 0


# phrases


def plain_phrases(rows, least, top, contained):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        found = f[lang]
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * inside[p] >= contained * a:
                continue
            score, _, l, r = min((2000000 * a // (found[p[:c]] + found[p[c:]]), c, found[p[:c]], found[p[c:]]) for c in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return out


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("least, top, head, dense", [(30, 2000, 1 << 18, 1 << 12), (5, 100, 1 << 18, 4), (3, 10**6, 12, 1 << 12), (4, 50, 0, 4)])
def test_phrases_equal_plain_loops(spark, rows, monkeypatch, least, top, head, dense):
    """Heads of all sizes, tiles and lists: the same counts."""
    docs = frame(spark, rows + rows[:40]).repartition(3)
    found = [tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, least, top, 80, head).collect()]
    want = plain_phrases(rows + rows[:40], least, top, 80)
    assert len(want) > 30 and sorted(found) == sorted(want)


def test_tiles_and_lists_count_alike(monkeypatch):
    rng = np.random.default_rng(1)
    left, right = rng.zipf(1.3, 60_000) % 3000, rng.zipf(1.3, 60_000) % 3000
    want = Counter(zip(left.tolist(), right.tolist()))
    for dense, most in ((1, 96), (200, 96), (200, 1), (10**9, 96)):
        monkeypatch.setattr(phrases, "DENSE", dense)
        monkeypatch.setattr(phrases, "MOST_TILES", most)
        tiles, found = phrases.PairTiles(), Counter()
        for part in range(0, 60_000, 7_000):
            tiles.add(left[part : part + 7_000], right[part : part + 7_000])
        filled = len(tiles.dense) > 0
        for x, y, n in (*tiles.dense_pairs(1000), tiles.pairs(tiles.sparse.merged())):
            found.update(dict(zip(zip(x.tolist(), y.tolist()), n.tolist())))
        assert found == want and filled == (dense < 10**9)


def test_long_texts_take_several_rows(spark, monkeypatch):
    words = [f"w{i % 7}" for i in range(5000)]
    rows = [(1, " ".join(words), "en", "s")]
    docs = frame(spark, rows)
    counted = phrases.word_counts(docs)
    ids = phrases.distinct_ids(counted, counted, 1 << 18)
    monkeypatch.setattr(phrases, "ROW_IDS", 100)
    runs = phrases.id_runs(docs, ids)
    if runs.count() == 1:  # the workers do not see the patched size
        runs = spark.createDataFrame(list(_cut(np.frombuffer(runs.first()["ids"], ids.id_type)[:-1], 100)), "ids binary, old int")
    found = Counter({(r["w1"], r["w2"]): r["n"] for r in phrases.phrase_counts(runs, 2, None, ids.id_type).collect()})
    assert sum(found.values()) == 4999 and len(found) == 7


def _cut(ids, size):
    at, old = 0, 0
    while at < len(ids):
        yield np.append(ids[at - old : at - old + size], 0).astype(ids.dtype).tobytes(), old
        at += size - old
        old = 3


def test_phrases_of_empty_tables(spark):
    found = phrases.collocations(frame(spark, []))
    assert found.columns == list(COLUMNS) and found.count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None, None), (2, "a b", "en", "s")])).count() == 0


def test_clashing_word_hashes_are_salted_anew(spark, rows, monkeypatch):
    docs = frame(spark, rows[14:40])
    counted = phrases.settle(phrases.word_counts(docs), "test-words")
    real = phrases.with_ids
    tried = []

    def clashing(words, table_of_ids):
        tried.append(table_of_ids.salt)
        found = real(words, table_of_ids)
        return found.withColumn("id", phrases.F.lit(-5).cast("long")) if table_of_ids.salt == 0 else found

    monkeypatch.setattr(phrases, "with_ids", clashing)
    assert phrases.distinct_ids(counted, counted, 3).salt == 1 and tried == [0, 1]
