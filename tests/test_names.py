"""Keys of name tokens and the fuzzy join on them, against all pairs."""

import random

import pytest

from cuebeam.functions import names
from cuebeam.operators import mentions


def changed(rng, token, most):
    """A token after up to so many edits, swaps of neighbours among them."""
    for _ in range(rng.randint(0, most)):
        k = rng.randrange(len(token) + 1)
        way = rng.choice("sdit")
        if way == "s":
            token = token[:k] + rng.choice("abcdesz'1") + token[k + 1 :]
        elif way == "d":
            token = token[:k] + token[k + 1 :]
        elif way == "i":
            token = token[:k] + rng.choice("abcdesz'1") + token[k:]
        else:
            token = token[:k] + token[k + 1 : k + 2] + token[k : k + 1] + token[k + 2 :]
    return token


@pytest.mark.parametrize("phonetic", [True, False])
def test_similar_tokens_share_a_key(phonetic):
    rng, met = random.Random(3), 0
    for _ in range(30_000):
        a = "".join(rng.choices("abcdesklmnorst", k=rng.choice([4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 20, 40])))
        b = changed(rng, a, 4) + rng.choice(["", "", "s", "'s", "s's"])
        if a != b and abs(len(a) - len(b)) <= 3 and names.similarity(a, b, phonetic)[0]:
            met += 1
            assert set(names.token_keys(a, phonetic)) & set(names.token_keys(b, phonetic)), (a, b)
    assert met > 8000 and max(len(names.token_keys(changed(rng, "abcdefghijklmnopqrst" * 5, 3))) for _ in range(50)) <= 64 + 3


@pytest.mark.parametrize("phonetic", [True, False])
def test_token_pairs(spark, phonetic):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdelmnorstu", k=rng.randint(3, 13))) for _ in range(60)]
    known = [(j, t) for j in "ab" for t in rng.sample(stems, 40)] + [("a", ""), ("a", "umg")]
    heard = [(j, changed(rng, t, 4) + rng.choice(["", "'s"])) for j in "abc" for t in stems for _ in range(6)] + known
    want = set()
    for j, x in known:
        for i, y in heard:
            if i == j and x and y and (x == y or (len(x) >= 4 and abs(len(x) - len(y)) <= 3 and names.similarity(x, y, phonetic)[0])):
                want.add((j, x, y, 1.0 if x == y else round(names.similarity(x, y, phonetic)[1], 9)))
    k, h = spark.createDataFrame(known, "job_id string, known string"), spark.createDataFrame(heard, "job_id string, heard string")
    got = [(r["job_id"], r["known"], r["heard"], round(r["score"], 9)) for r in mentions.token_pairs(k, h, phonetic=phonetic).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("phonetic", [True, False])
def test_token_pairs_by_keys(spark, monkeypatch, phonetic):
    """Tokens that meet by their keys give the pairs that all pairs give."""
    monkeypatch.setattr(mentions, "MOST_PAIRS", 0)
    test_token_pairs(spark, phonetic)


def test_candidates_of_other_sounds_are_few_edits_apart(spark):
    """The wider budget is for tokens that sound alike: others are not compared any further."""
    k, h = (spark.createDataFrame([("j", t) for t in x], f"job_id string, {c} string") for c, x in (("known", ["montgomery"]), ("heard", ["montgomery", "montgamary", "mongtomeyr", "mantronery"])))
    assert {r["heard"] for r in mentions.token_candidates(k, h).collect()} == {"montgamary", "mongtomeyr"}


def test_candidates_grow_with_the_input(spark):
    """Of random words, ten times as many have about ten times as many candidates for each known one, far below all pairs of a first letter."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(7, 11)))
    known = [("j", word()) for _ in range(100)]
    k = spark.createDataFrame(known, "job_id string, known string")
    for n in (1000, 10_000):
        heard = [("j", word()) for _ in range(n)]
        same_letter = sum(x[0] == y[0] for _, x in known for _, y in heard)
        assert mentions.token_candidates(k, spark.createDataFrame(heard, "job_id string, heard string"), phonetic=False).count() < same_letter / 50


def test_declared_names_are_bounded(spark):
    from cuebeam.plans.analyse import analyse

    declared = spark.createDataFrame([("j", 0, "x" * 81)], "job_id string, name_ord long, name string")
    cues = spark.createDataFrame([("j", 0, 0, 1000, "x")], "job_id string, cue_index long, start_ms long, end_ms long, text string")
    clips = spark.createDataFrame([], "job_id string, clip_ord long, clip_id string, filename string, tags array<string>, duration_ms long")
    with pytest.raises(ValueError, match="81"):
        analyse(cues, clips, declared=declared)


@pytest.mark.parametrize("phonetic", [True, False])
def test_batches_are_compared_as_pairs_are(phonetic):
    rng = random.Random(5)
    a = ["".join(rng.choices("abcdesph's", k=rng.choice([0, 1, 3, 4, 5, 6, 7, 8, 10, 11, 14, 31, 32, 33, 60]))) for _ in range(8000)]
    b = [changed(rng, x, 6) for x in a]
    a, b = [*a, "Anna", "x\0", "münchen"], [*b, "anna", "x", "munchen"]
    found = names.similarities(a, b, phonetic).itertuples(index=False, name=None)
    assert [tuple(x) for x in found] == [names.similarity(x, y, phonetic) for x, y in zip(a, b, strict=True)]
    assert len(names.similarities([], [], phonetic)) == 0


def test_letters_tell_how_far_tokens_are_apart_at_least():
    rng, far = random.Random(8), 0
    for _ in range(20_000):
        a = "".join(rng.choices("abcdesph'z_5é", k=rng.choice([1, 4, 7, 9, 12, 40])))
        b = changed(rng, a, 6)
        assert names.letters_apart(a, b) <= 2 * names.osa_distance(a, b), (a, b)
        far += names.letters_apart(a, b) > 4
        if (x := a.removesuffix("s").removesuffix("'s")) and names.similarity(a, x)[2] == "exact":
            assert names.letters_apart(a, x) <= 3
    assert far > 1000 and names.letters_apart("market", "tramke") == 0


def test_batches_remember_no_pairs():
    names.osa_distance.cache_clear(), names.similarity.cache_clear()
    rng = random.Random(6)
    a = ["".join(rng.choices("abcdes", k=rng.choice([8, 40]))) for _ in range(3000)]
    names.similarities(a, [changed(rng, x, 3) for x in a])
    assert names.osa_distance.cache_info().currsize == names.similarity.cache_info().currsize == 0
