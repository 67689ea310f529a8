import random
import zlib

import pytest

from loftline.llm import toxicity as X

MACHINE, READER = X.grammar(), X._Reader(X.Lexicon({"idiot": 4.0}, {"vequ": 5.0}))


def score(text):
    return X.score_text(text, READER, MACHINE)[0]


def test_grammar_weighs_scope():
    assert score("you idiot") > score("an idiot") > score("she said an idiot") > 0
    assert score("an idiot") > score("he is not an idiot at all") > 0
    assert score("never never never") == score("") == score("the weather is fine") == 0
    assert score("i will kill you") > score("kill the lights") > 0
    assert score("VEQUAIS") == score("vequx") > 0


def test_scope_ends_with_the_clause():
    assert score("they said so. an idiot") == score("an idiot")
    assert score("not now, an idiot") == score("an idiot")


def predicted(text, reader=X._Reader(X.Lexicon({w: X.GENERAL_WEIGHT for w in X.INSULTS}))):
    return X.score_text(text, reader, MACHINE)[0] >= X.THRESHOLD


def test_isolated_words_and_negated_threats_are_not_toxic():
    assert not predicted("idiot") and not predicted("the clown fish. " * 3) and not predicted("we shoot photos for you. " * 2)
    assert not predicted("you didn't kill") and not predicted("you didn\u2019t hurt anyone")
    assert predicted("you are an idiot") and predicted("i will kill you") and predicted("du bist ein trottel")
    assert not predicted("she said he is no idiot")


def test_evidence_is_in_proportion_to_clauses():
    clean, reader = "nothing is here. " * 400, X._Reader(X.Lexicon({"idiot": 4.0}, rate=0.01))
    assert X.score_text(clean, reader, MACHINE)[0] == 0
    assert 0 < X.score_text("you idiot. " + clean, reader, MACHINE)[0] < X.score_text("you idiot.", reader, MACHINE)[0]
    assert predicted("you are an idiot. " + "word " * 100_000)


def test_composition_equals_machines_in_turn():
    rng, machines = random.Random(1), (X.negation(), X.reported(), X.targeted())
    for _ in range(200):
        symbols = [(s, float(s in (X.INSULT, X.THREAT)) * 2) for s in (rng.randrange(X.END) for _ in range(8))]
        states, total = [0, 0, 0], 0.0
        for symbol, weight in [*symbols, (X.END, 0.0)]:
            for k, machine in enumerate(machines):
                arc = machine.step(states[k], symbol)
                states[k], symbol, weight = arc.to, arc.out, weight * arc.times + arc.plus
            total += weight
        assert X.clause_score(symbols, MACHINE) == pytest.approx(total)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["zargon", "zilpak", "zilpex", "zilpud"]))
        rows.append((i, " ".join(words), "x"))
        if i % 10 != 3:
            labels.append((i, 1, int(toxic)))
    rows += [(2000, None, "x"), (2001, "", "x"), (None, "zargon", "x"), (2002, "da " * 100_000 + "zargon", "x"), (5, rows[5][1], "x")]
    labels += [(None, 1, 1), (7, None, None), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(tables):
    docs, labels, rows = tables
    lexicon = X.fit_lexicon(docs, labels)
    assert "zargon" in lexicon.words and not {"da", "ba"} & set(lexicon.words)
    got = X.score_documents(docs, lexicon).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == X.HELD_OUT]
    right = sum(r.predicted == (r.doc_id % 6 == 0) for r in held)
    assert right / len(held) >= 0.97
    by = {r.doc_id: r for r in got}
    assert by[2000].score == by[2001].score == 0.0 and by[2002].predicted == by[None].predicted == 1


def test_nothing_to_learn_or_score(tables):
    docs, labels, _ = tables
    assert X.fit_lexicon(docs, labels.limit(0)).words.keys() == set(X.INSULTS)
    assert X.score_documents(docs.limit(0), X.Lexicon()).collect() == []


def test_rare_insults_are_learned_however_many_labels(spark):
    """A term of six toxic texts among hundreds counts, in texts that open alike too; one of clean texts does not."""
    fit = [i for i in range(0, 3000, 6) if zlib.crc32(str(i).encode()) % 4 != X.HELD_OUT]
    opening = "this passage opens several texts alike "
    rows = []
    for i in range(3000):
        words = ["vile" if i % 6 == 0 else "nothing", f"number{i}", opening if i in fit[:6] or i % 6 == 1 else "", "bococion" if i in fit[:6] else "", "dubious" if i % 60 < 2 else ""]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    words = X.fit_lexicon(docs, labels).words
    assert 6 < 0.02 * len(fit)
    assert "bococion" in words and "vile" in words and not {"dubious", "nothing", "passage"} & set(words)
