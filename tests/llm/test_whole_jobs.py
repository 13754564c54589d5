"""Cases in which an operator once did less than its whole job."""

import random

import pytest
from spanvec.llm import license_scan, secrets, simhash
from pyspark.sql import functions as F

KEY = "sk9Qw8Er7Ty6Ui5Op4As3Df2Gh1J"


def test_secret_copied_inside_one_source(spark):
    """Many repositories of one owner hold the key: an example; few do, or each of several owners has few: live."""
    other, third = KEY[::-1], KEY.swapcase()
    rows = [(i, f"x {KEY} y", "hot") for i in range(40)] + [(100 + i, f"x {other} y", "hot") for i in range(10)] + [(200 + i, f"x {third} y", f"s{i % 2}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.a for r in secrets.scan(df).select("doc_id", secrets.spelled(F.col("all_spans")).alias("a")).collect()}
    assert got == {i: "" if i < 40 else "live:2:30" for i, *_ in rows}


def test_repeated_notices_are_all_found():
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, n in (("all-rights-reserved", 50), ("mit-notice", 7), ("cc-by-nc-4.0-notice", 4), ("apache-2.0-notice", 3)):
        notice = license_scan.TEMPLATES[name].strip() + "\n"
        got = [m for m in index.matches(notice * n) if m[0] == name]
        assert [m[2] for m in got] == [i * len(notice) for i in range(n)] and all(m[1] == 1 for m in got)


def test_interrupted_partial_and_edited_licenses(spark):
    text = license_scan.TEMPLATES["mit"]
    words = text.split()
    half = len(words) // 2
    index = license_scan.Index(license_scan.TEMPLATES)
    header = " ".join(f"page{i}" for i in range(30))
    cut = " ".join([*words[:half], header, *words[half:]])
    assert [m for m in index.matches(cut) if m[0] == "mit"] == [("mit", 1.0, 0, len(cut.rstrip(".")))]
    notice = "Released under an MIT License"
    assert ("mit-notice", 0.8, 0, len(notice)) in index.matches(notice)
    part = " ".join(words[: int(0.7 * len(words))])
    (r,) = license_scan.scan(spark.createDataFrame([(1, part)], "doc_id long, text string")).collect()
    assert not [m for m in r.matches if m.template == "mit"]
    (m,) = [m for m in r.partial if m.template == "mit" and m.coverage > 0.5]
    assert 0.65 < m.coverage < 0.75 and (m.s, m.e) == (0, len(part.rstrip(".,")))
    assert len(index.matches((text + "\n") * 3)) == 3


def test_near_copies_beyond_four_bits(spark):
    """Every pair of texts with 5-word Jaccard of 0.8 or more loses its later one; op1's links stay as they are."""
    base = [f"w{i * 7919 % 1009}" for i in range(60)]
    rows = [(0, " ".join(base), "a")]
    for i in range(1, 25):
        w = list(base)
        w[2 * i + 4] = f"other{i}"
        rows.append((i, " ".join(w), "a"))
    rows.append((50, " ".join(f"v{i}" for i in range(60)), "a"))
    bits = [(simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(t.encode())).bit_count() for _, t, _ in rows]
    assert max(bits[1:25]) > simhash.CLOSE
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == {0, 50}
    assert len({r.component_id for r in simhash.near_duplicates(df, similarity=None).collect()}) > 2


def whole_alignment(words, template, taken):
    """Best local alignment over the whole text, without an index or a band: (score, matched, first, last) word of the text."""
    none = (0, 0, -1, -1)
    row, best = [none] * (len(words) + 1), none
    for t in template:
        new = [none] * (len(words) + 1)
        for i, w in enumerate(words):
            if i in taken:
                continue
            s, m, a, b = row[i]
            cell = (s + 2, m + 1, i if a < 0 else a, i) if w == t else (s - 1, m, a, b)
            for s, m, a, b in (row[i + 1], new[i]):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, a, b)
            new[i + 1] = cell if cell[0] > 0 else none
            if cell[:2] > best[:2]:
                best = new[i + 1]
        row = new
    return best


def slow_matches(text, name):
    """Spans of one template: whole alignments, best first, until what is left covers too little."""
    words = license_scan.WORD.findall(license_scan.low_ascii(text))
    offsets = [m.span() for m in license_scan.WORD.finditer(license_scan.low_ascii(text))]
    template = license_scan.WORD.findall(license_scan.low_ascii(license_scan.TEMPLATES[name]))
    taken, found = set(), []
    while True:
        _, matched, first, last = whole_alignment(words, template, taken)
        if matched < license_scan.LEAST_COVERAGE * len(template):
            return sorted(found)
        taken.update(range(first, last + 1))
        found.append((offsets[first][0], offsets[last][1], round(matched / len(template), 9)))


@pytest.mark.parametrize("seed", range(12))
def test_matches_equal_whole_alignments(seed):
    """Repeated, adjoining and edited notices and licenses in noise that shares their words, at all places."""
    rng = random.Random(seed)
    index = license_scan.Index(license_scan.TEMPLATES)
    names = sorted(license_scan.TEMPLATES)
    noise = ["the", "software", "license", "of", "alpha", "beta", "gamma", "delta", "rights", "public"]
    parts, used = [], set()
    for _ in range(6):
        name = rng.choice(names)
        w = license_scan.TEMPLATES[name].split()
        for _ in range(len(w) // 25):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["changed"], [w[at], "added"]])
        used.add(name)
        parts += [" ".join(w)] * rng.choice([1, 1, 3]) + [" ".join(rng.choice(noise) for _ in range(rng.choice([0, 9, 40])))]
    text = "\n".join(parts)
    for name in used:
        got = [(s, e, round(c, 9)) for t, c, s, e in index.matches(text) if t == name]
        assert got == slow_matches(text, name)


def test_license_ties_and_long_texts():
    """Equal spans of two templates are ordered by name; a long text is searched to its end."""
    index = license_scan.Index({"b": "one two three four five", "a": "one two three four five"})
    assert index.matches("one two three four five") == [("a", 1.0, 0, 23), ("b", 1.0, 0, 23)]
    whole = license_scan.Index(license_scan.TEMPLATES)
    text = "plain words of no license. " * 100_000 + license_scan.TEMPLATES["mit"]
    assert [m[0] for m in whole.matches(text)] == ["mit"]
