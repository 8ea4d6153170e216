import random

from tests.llm.conftest import ODD
from tidewatch.llm.langid import fit, predict, trained

VOICE = {"en": "the and ing tion her for that with have this", "de": "der und ich nicht sch ein mit auf ung zu",
         "es": "los que para ñor ción una por está mente ado"}


def texts(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    parts = VOICE[lang].split()
    return [" ".join(rng.choice(parts) + rng.choice(parts) for _ in range(60)) for _ in range(n)]


def test_held_out_accuracy_and_mixtures(spark):
    rows = [(t, lang) for lang in VOICE for t in texts(lang, 40, 1)]
    model = fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert model.languages == ["de", "en", "es"]
    tests = [(lang, t) for lang in VOICE for t in texts(lang, 20, 2)]
    mixed = [("mix", a + " " + b) for a, b in zip(texts("en", 10, 3), texts("es", 10, 3))]
    got = predict(spark.createDataFrame(tests + mixed, "want string, text string"), model).select("row.want", "found.*").collect()
    single = [r for r in got if r["want"] != "mix"]
    assert all(r["want"] == r["lang_pred"] and r["languages"] == [r["want"]] for r in single)
    for r in got:
        assert 0 <= r["score"] <= 1 and abs(sum(r["shares"]) - 1) < 1e-5
    for r in (r for r in got if r["want"] == "mix"):
        assert set(r["languages"]) == {"en", "es"} and 0.3 < r["shares"][0] < 0.7


def test_odd_rows(odd, nothing):
    model = fit(odd, "text", "lang")
    got = predict(odd, model).select("row.doc_id", "row.text", "row.found", "found.lang_pred", "found.score").collect()
    assert len(got) == len(ODD) and all(r["found"] == "clash" for r in got)
    said = {r["doc_id"]: r["lang_pred"] for r in got}
    assert said[1] == said[2] == said[3] == said[8] == "und" and said[7] == "de"
    assert said[4] in model.languages and said[5] == said[6] == "en"
    assert predict(nothing, model).count() == 0
    assert [r[0] for r in predict(odd, trained(nothing)).select("found.lang_pred").distinct().collect()] == ["und"]


def test_texts_shorter_than_a_gram_are_judged(spark):
    rows = [("ja der nun so", "de"), ("wie ja", "de"), ("si che no e lo", "it"), ("e no si", "it"), ("lo e", "it")] * 20
    model = fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    wanted = {"si": "it", "no": "it", "e": "it", "ja": "de", "so": "de", "": "und", " 1 ": "und", "?": "und"}
    got = predict(spark.createDataFrame([(t,) for t in wanted], "text string"), model)
    got = {r[0]: r[1:] for r in got.select("row.text", "found.lang_pred", "found.score").collect()}
    assert {t: r[0] for t, r in got.items()} == wanted
    assert all((score > 0) == (lang != "und") for lang, score in got.values())
