"""Quality rules, line and substring deduplication against plain versions."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evloom.llm import line_dedup, quality_rules, substring_dedup

SF = "/root/testdata/sf0.001"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def check_base(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = Counter((r["doc_id"], base(r["text"])) for r in docs.collect())
    out = quality_rules.judge(docs).collect()
    assert Counter((r["doc_id"], tuple(r[n] for n in names)) for r in out) == want
    assert not any(r["kept"] and r["base_failed"] for r in out)
    assert all(0 <= r["quality"] <= 1 for r in out)
    return out


def test_quality_base_counts(spark, awkward, nothing):
    check_base(awkward)
    assert quality_rules.judge(nothing).count() == 0
    out = {r["doc_id"]: r for r in check_base(spark.read.parquet(f"{SF}/documents.parquet"))}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [out[r["doc_id"]]["kept"] == (r["quality"] == 1) for r in labels if not out[r["doc_id"]]["base_failed"]]
    assert sum(right) >= 0.95 * len(right)


def test_estimate_matches_plain_em(spark):
    votes = [((1, 1, 0), 60), ((1, 0, 1), 20), ((-1, -1, 1), 9), ((-1, 0, -1), 6), ((0, -1, 1), 2)]
    frame = spark.createDataFrame([v for v, n in votes for _ in range(n)], "a int, b int, c int")
    got = quality_rules.estimate(frame, ["a", "b", "c"])
    prior, good, bad = 0.8, [0.98] * 3, [0.4] * 3
    for _ in range(40):
        sums = [[0.0] * 4 for _ in range(3)]
        g_all = b_all = 0.0
        for v, n in votes:
            g, b = prior, 1 - prior
            for j, x in enumerate(v):
                g, b = (g * good[j], b * (1 - bad[j])) if x == 1 else (g * (1 - good[j]), b * bad[j]) if x == -1 else (g, b)
            p = g / (g + b)
            g_all, b_all = g_all + n * p, b_all + n * (1 - p)
            for j, x in enumerate(v):
                sums[j] = [s + d for s, d in zip(sums[j], (n * p * (x == 1), n * p * (x != 0), n * (1 - p) * (x == -1), n * (1 - p) * (x != 0)))]
        new = ((g_all + 8) / (g_all + b_all + 10), [min(0.99, max(0.98, (s[0] + 9.8) / (s[1] + 10))) for s in sums],
               [min(0.95, max(0.05, (s[2] + 4) / (s[3] + 10))) for s in sums])
        moved = max(abs(a - b) for a, b in zip([new[0], *new[1], *new[2]], [prior, *good, *bad]))
        prior, good, bad = new
        if moved < 1e-3:
            break
    for a, b in zip([got.prior, *got.on_good, *got.on_bad], [prior, *good, *bad]):
        assert abs(a - b) < 1e-9


def plain_lines(rows, window=2, min_chars=40):
    """Runs of lines with an earlier copy, for rows (id, text) in order with distinct ids.

    A boundary between two lines holds if a window over it stands earlier; a run is what lies between boundaries that do not.
    """
    seen, dropped = set(), {}
    for i, text in sorted(rows):
        lines = [x.strip(" ") for x in text.split("\n")]
        marked, held = [False] * len(lines), [False] * (len(lines) + 1)
        for width in {window, 1}:
            for p in range(len(lines) - width + 1):
                key = tuple(lines[p:p + width])
                if key in seen and (width == window or len(lines[p]) >= min_chars):
                    marked[p:p + width] = [True] * width
                    held[p + 1:p + width] = [True] * (width - 1)
                seen.add(key)
        drop, p = set(), 0
        while p < len(lines):
            q = p + 1
            while q < len(lines) and held[q]:
                q += 1
            if marked[p] and sum(map(len, lines[p:q])) >= min_chars:
                drop |= set(range(p, q))
            p = q
        dropped[i] = (len(drop), "\n".join(x for p, x in enumerate(text.split("\n")) if p not in drop))
    return dropped


def test_line_dedup_matches_plain(spark, awkward, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_removed_lines"], r["text"]) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == want
    lines = ["a" * 30, "b" * 30, "c" * 250, "d", "e" * 30]
    small = [(i, "\n".join(lines[(i * k * k + k) % 5] for k in range(9))) for i in range(12)]
    frame = spark.createDataFrame(small, "doc_id long, text string")
    for window in (1, 2, 3):
        got = {r["doc_id"]: (r["n_removed_lines"], r["text"]) for r in line_dedup.drop_repeated_lines(frame, window=window).collect()}
        assert got == plain_lines(small, window), window
    out = line_dedup.drop_repeated_lines(awkward)
    assert out.columns == [c for c in awkward.columns if c != "n_lines"] + ["n_lines", "n_removed_lines"]
    rows = {(r["doc_id"], r["n_removed_lines"]) for r in out.collect()}
    assert out.count() == awkward.count() and {(1, 0), (2, 1), (3, 2), (None, 0), (4, 0), (5, 0)} <= rows
    assert line_dedup.drop_repeated_lines(nothing).count() == 0


def test_maximal_runs_of_lines(spark):
    short = "\n".join(f"item {i}" for i in range(15))
    mixed = "\n".join(["L" * 45, "a", "b", "c", "M" * 45])
    alone = "only one line of its own kind " * 4
    rows = [(1, short), (2, "before\n" + short + "\nafter"), (3, mixed), (4, "x\n" + mixed + "\ny"), (5, alone), (6, "p\n" + alone + "\nq"),
            (7, "yes\nno\nthanks"), (8, "yes\nno\nthanks"), (9, "a\n\n\n"), (10, "\n\n\n" + short)]
    frame = spark.createDataFrame([(i, t, "t", "l") for i, t in rows], "doc_id long, text string, __th string, __l string")
    out = line_dedup.drop_repeated_lines(frame)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert {i: got[i] for i in (2, 4, 6)} == {2: "before\nafter", 4: "x\ny", 6: "p\nq"}
    assert all(got[i] == t for i, t in rows if i in (1, 3, 5, 7, 8, 9))
    assert {i: (r["n_removed_lines"], r["text"]) for r in out.collect() for i in [r["doc_id"]]} == plain_lines(rows)
    assert out.select("__th", "__l").distinct().collect() == [("t", "l")]


def test_hot_line_stays_once(spark):
    hot = "z" * 300
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(hot + "\nown "), F.col("id")))
                                     .otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    out = line_dedup.drop_repeated_lines(frame)
    assert out.where(F.col("text").contains(hot)).select("doc_id").collect() == [(0,)]
    assert out.where("n_removed_lines > 0").count() == 999


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab.! \n?", max_size=80))
def test_units_cover_the_text(text):
    units = substring_dedup.split_units(text, 3)
    assert all(a < b for a, b, *_ in units) and all(x[1] == y[0] for x, y in zip(units, units[1:]))
    assert sum(u[2] for u in units) == len(text.split())


def plain_substrings(rows, min_words=12):
    """Spans of repeated sentences per id, by the sentences' words themselves instead of digests; distinct ids."""
    seen, spans = set(), {}
    for i, text in sorted(rows):
        parts = [m for m in re.finditer(r"\S.*?(?:[.!?؟۔।॥]+\s+|[。！？．]+\s*|\n+|$(?!\n))", text or "", re.DOTALL)]
        spans[i], run = [], []
        for m in [*parts, None]:
            key = tuple(m.group().lower().split()) if m else None
            if key in seen:
                run.append(m)
                continue
            seen.add(key) if m else None
            if sum(len(x.group().split()) for x in run) >= min_words:
                spans[i].append((run[0].start(), run[-1].end() - run[0].start()))
            run = []
    return spans


def test_substring_dedup_matches_plain(spark, awkward, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_substrings([(r["doc_id"], r["text"]) for r in docs.collect()])
    out = substring_dedup.remove_repeats(docs).collect()
    original = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out:
        # a unit that follows blank lines holds them, the plain sentence starts at its first word
        got = [(s + len(t) - len(t.lstrip()), len(t.lstrip())) for s, n in r["removed"] for t in [original[r["doc_id"]][s:s + n]]]
        assert got == want[r["doc_id"]]
        assert len(r["text"]) + r["n_removed_chars"] == len(original[r["doc_id"]])
    rows = substring_dedup.remove_repeats(awkward).collect()
    assert len(rows) == awkward.count() and {r["text"] for r in rows if r["doc_id"] in (4, 5)} == {None, ""}
    assert [r["n_removed_chars"] > 0 for r in rows if r["doc_id"] in (1, 2)] == [False, True]
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_every_later_copy_of_a_line_goes(spark):
    line = "this line of fourteen words stands in every one of the fifty documents here"
    frame = spark.createDataFrame([(i, f"Own text {i}. Hm {i}.\n{line}\nend {i}") for i in range(50)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(frame).collect()}
    assert [i for i in out if line in out[i]] == [0] and out[7] == "Own text 7. Hm 7.\nend 7"
    # a short sentence before a passage does not hide its first sentence
    passage = " ".join(f"Sentence number {i} has a few words of its own." for i in range(6))
    frame = spark.createDataFrame([(1, passage), (2, f"Oh. {passage} Bye now."), (3, "これは文です。" + "短い。")], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_units"]) for r in substring_dedup.remove_repeats(frame).collect()}
    assert out[2][0] == "Oh. Bye now." and out[3] == ("これは文です。短い。", 2)


def test_passage_inside_a_line_is_found(spark):
    passage = " ".join(f"Word{i} goes on and on{i}." for i in range(14))
    frame = spark.createDataFrame([(1, f"A start of its own here. {passage} An end."), (2, f"Another one begins so. {passage}"), (3, "Nothing in common here at all.")],
                                  "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(frame).collect()}
    assert passage in out[1] and "Word3" not in out[2] and out[2].startswith("Another one begins so.") and out[3] == "Nothing in common here at all."
