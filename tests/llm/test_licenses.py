"""License places against an alignment of every template at every place."""

import random

import pytest

from lookback.llm import licenses


def lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edited(words: list[str], rng: random.Random, rate: float) -> list[str]:
    """Words of which a share is replaced, left out or doubled, singly or a few in a row."""
    out, k = [], 0
    while k < len(words):
        if rng.random() < rate / 2:
            n = rng.choice([1, 1, 2, 4])
            out += rng.choice([[], ["qq"] * n, [words[k], "qq"]])
            k += n
        else:
            out.append(words[k])
            k += 1
    return out


def words_of(text: str) -> list[str]:
    return licenses.TOKEN.findall(text.lower())


@pytest.fixture(scope="module")
def places():
    """(doc_id, template, text) of notices edited by all shares up to two fifths, amid other words."""
    rng, out = random.Random(11), []
    notices = [n for n, t in licenses.TEMPLATES.items() if len(words_of(t)) >= 20]
    for k in range(400):
        name = rng.choice(notices)
        around = ["lorem", "of", "the", "software", "ipsum", "license", "dolor"]
        body = edited(words_of(licenses.TEMPLATES[name]), rng, rng.uniform(0, 0.4))
        out.append((k, name, " ".join(rng.choices(around, k=rng.randint(0, 200)) + body + rng.choices(around, k=rng.randint(0, 200))), body))
    return out


def test_places_equal_an_alignment_of_every_template(spark, places):
    docs = spark.createDataFrame([(k, text) for k, _, text, _ in places], "doc_id long, text string")
    whole = {n: words_of(t) for n, t in licenses.TEMPLATES.items()}
    found, exact = ({} for _ in range(2))
    for out, window in ((found, licenses.WINDOW), (exact, 1)):
        for r in licenses.scan(docs, window=window).collect():
            out.setdefault(r["doc_id"], []).append(r)
    there = caught = caught_exactly = 0
    for k, name, text, body in places:
        # which templates the place has, whatever its words' order of discovery
        having = {n for n, t in whole.items() if len(t) >= 20 and lcs(t, body) >= licenses.COVERAGE * len(t)}
        if name not in having:
            continue
        there += 1
        caught += any(r["license"] in having for r in found.get(k, ()))
        caught_exactly += any(r["license"] in having for r in exact.get(k, ()))
    assert there > 200 and caught >= 0.97 * there and caught_exactly >= caught, (there, caught, caught_exactly)
    for k, _, text, _ in places:
        for r in found.get(k, ()):
            span, t = words_of(text[r["span_start"] : r["span_end"]]), whole[r["license"]]
            best = lcs(t, span)
            # what is reported is in the span, and hardly less than the best alignment of the span
            assert licenses.COVERAGE * len(t) <= r["matched_words"] <= best <= r["matched_words"] + max(2, 0.05 * len(t))


def test_the_index_holds_winnowed_fingerprints():
    index, every = licenses.Index(licenses.TEMPLATES), licenses.Index(licenses.TEMPLATES, 1)
    assert 0.5 * sum(every.prints) < sum(index.prints) < 0.8 * sum(every.prints)
    # any WORDS + WINDOW - 1 words in a row hold one of their template's fingerprints
    for t, ids in enumerate(index.templates):
        kept = {i for posts in index.postings for u, i in posts if u == t}
        run = licenses.WORDS + licenses.WINDOW - 1
        assert all(any(i in kept for i in range(a, a + licenses.WINDOW)) for a in range(len(ids) - run + 1))


def test_a_band_wide_enough_is_the_whole_alignment():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        assert licenses.common(a, b, 20) == lcs(a, b)
        assert licenses.common(a, b, 2) <= lcs(a, b)


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "own-1.0.txt").write_text("you may\ndo with this as you please always")
    got = licenses.read_templates(spark, f"file://{tmp_path}")
    assert got == {"own-1.0": "you may\ndo with this as you please always"}
    docs = spark.createDataFrame([(1, "so: you may do with this as you please always.")], "doc_id long, text string")
    assert [r["license"] for r in licenses.scan(docs, got).collect()] == ["own-1.0"]
