"""Prose behind a credential word stays; what is costly to guess doesn't."""

from metrika.llm import secret_scan


def test_prose_stays(spark):
    prose = ["the mountain pass is dangerous", "trespass is forbidden", "the secret is everything", "nothing is dangerous, forbidden or everything."]
    rows = prose[:3] + prose[3:] * 6 + ["my pass is xkqzvwjhpd", "PGPASSWORD=xK9#qLz!7vRt2", "dbpwd: xK9#qLz!7vRt2", None] + ["the token is qhzkwvxjtb"] * 6
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.mask_documents(docs).collect()}
    # a secret in six documents is no word of the dictionary
    secrets = ["my pass is [SECRET]", "PGPASSWORD=[SECRET]", "dbpwd: [SECRET]", None] + ["the token is [SECRET]"] * 6
    assert [got[i] for i in range(len(rows))] == rows[:9] + secrets
    found = secret_scan.find(docs, ["doc_id"]).where("n_guess > 0 or n_assign > 0").count()
    assert found == 9


#: Words of prose, none of which a test's value is.
PROSE = """the quick answer to every question about training was never written down because nobody believed that the
committee would accept a proposal without considerable preparation and several independent reviews of measurable
progress an unusual but remarkable performance requires patience persistence and severe discipline over many years
the available evidence reveals that comfortable people rarely reconsider their favourable beliefs until something
incredible happens and even then a believable explanation is preferred to the inconvenient truth""".split()


def test_unseen_words_stay_in_prose_alone(spark):
    said = ["The password is unbelievable to me.", "the secret is perseverance", "The secret is Well-Mannered conversation", "the secret is PERSEVERANCE!"]
    kept = ["the password is xkqzvwjhpdqz", "the password is unbelievaBle", "the password is unbelievable7#Qz", "password: unbelievablyx", "pwd: perseverancex", "the secret is zqxjkvbqwzxkjqvbzxqk", "the secret is correcthorsebatterystaple"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*said, *kept, " ".join(PROSE), None, ""])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.find(docs, ["doc_id"]).collect()}
    assert [got[i]["n_guess"] for i in range(len(said))] == [0] * len(said)
    assert [got[len(said) + i]["n_guess"] + got[len(said) + i]["n_assign"] for i in range(len(kept))] == [1] * len(kept)
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask_documents(docs).collect()}
    assert [masked[i] for i in range(len(said))] == said and all("[SECRET]" in masked[len(said) + i] for i in range(len(kept)))


def test_letters_without_a_corpus_say_nothing():
    assert not secret_scan.like_word("unbelievable", {}) and not secret_scan.like_word("", {})
    even = secret_scan.pair_weights({})
    assert set(even.values()) == {-1.0} and not secret_scan.like_word("unbelievable", even)


def test_the_most_frequent_words(spark):
    """The frequency from which on words are kept against sorting them all."""
    for of in ([3, 4], [5] * 10, [5] * 6 + [7] * 3, [9, 8, 7, 6, 5], [5000, 5001, 70_000, 70_001, 9], []):
        counts = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate(of)], "word string, n long")
        for bound in (0, 1, 2, 4, 100):
            least = secret_scan.frequent_from(counts, bound)
            kept = [n for n in of if n >= least]
            assert len(kept) <= bound and least >= secret_scan.LEAST_DOCS
            if max(of, default=0) < 4096:  # every frequency is a level
                assert kept == [n for n in of if n >= 5 and sum(m >= n for m in of) <= bound]
