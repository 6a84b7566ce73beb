"""Languages by compression: held-out accuracy, mixed texts, labels, edge cases."""

import random

from apothecary.llm import languages as G

# A few invented sentences a language; names vary, so that no two texts are alike.
FORMS = {
    "en": ("The pharmacy in {} should check the bottle and tell the office how many units are left.", "Our hospital received only {} of the boxes that had been ordered before the holidays."),
    "es": ("La farmacia de {} debe revisar el frasco y avisar a la oficina de cuantas unidades quedan.", "Nuestro hospital recibió solamente {} de las cajas que se habían pedido antes de las fiestas."),
    "fr": ("La pharmacie de {} doit contrôler le flacon et dire au bureau combien d'unités il reste.", "Notre hôpital n'a reçu que {} des boîtes qui avaient été commandées avant les fêtes."),
    "de": ("Die Apotheke in {} sollte die Flasche prüfen und dem Büro sagen, wie viele Einheiten noch da sind.", "Unser Krankenhaus erhielt nur {} der Schachteln, die vor den Feiertagen bestellt worden waren."),
    "nl": ("De apotheek in {} moet de fles nakijken en het kantoor zeggen hoeveel stuks er nog zijn.", "Ons ziekenhuis kreeg maar {} van de dozen die voor de feestdagen waren besteld."),
}


def text(rng, lang, n=4):
    return " ".join(rng.choice(FORMS[lang]).format(rng.choice("Xala Qoro Velmi Trano Bresu".split()) + str(rng.randrange(9))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, "x") for i, (t, la) in enumerate(rows)], "doc_id bigint, text string, lang string, seg string")


def found(spark, rows):
    out = {}
    for r in sorted(G.find(docs(spark, rows)).collect(), key=lambda r: (r["doc_id"], r["seg"])):
        assert 0.5 <= r["confidence"] <= 1
        out.setdefault(r["doc_id"], []).append((r["seg"], r["lang"]))
    return out


def test_labels():
    good = {"en_GB": "en", " ENG ": "en", "español": "es", "Français": "fr", "fr-CA": "fr", "Nederlands": "nl", "ger": "de", "português": "pt", "und": None, "??": None, "": None, None: None, "xx": None}
    assert {k: G.label_code(k) for k in good} == good


def test_accuracy_with_wrong_labels(spark):
    rng = random.Random(4)
    truth = [rng.choice(sorted(FORMS)) for _ in range(400)]
    rows = [(text(rng, la), la if rng.random() < 0.9 else rng.choice(["en", "??", None, "de"])) for la in truth]
    got = found(spark, rows)
    for i, (la, (_, label)) in enumerate(zip(truth, rows)):
        assert got.get(i, []) == ([] if G.label_code(label) == la else [(1, la)]), (la, rows[i])


def test_mixed_and_odd_texts(spark):
    rng = random.Random(6)
    rows = [(text(rng, la), la) for la in sorted(FORMS) for _ in range(25)]
    n = len(rows)
    rows += [
        (text(rng, "en", 3) + "\n\n" + text(rng, "de", 2) + " " + text(rng, "en", 2), "en"), (None, None), ("", ""), ("  ", "??"), ("80787-775-15 P26302B\n44686-727-23", None),
        (text(rng, "fr", 1).replace(".", " («no congelar»)."), "fr"), ("# 12-X\n" + text(rng, "es"), "xx"), (text(rng, "nl", 300), None), ("⚕ 💊💊", "en"),
    ]
    got = found(spark, rows)
    assert {k - n: v for k, v in got.items() if k >= n} == {0: [(1, "en"), (2, "de"), (3, "en")], 6: [(1, "es")], 7: [(1, "nl")]}
    assert not [k for k in got if k < n]


def test_runs_of_short_sentences(spark):
    rng = random.Random(9)
    rows = [(text(rng, la), la) for la in sorted(FORMS) for _ in range(25)]
    n = len(rows)
    rows += [(text(rng, "en", 2) + " La farmacia de aquí. Debe revisar el frasco. Avisar a la oficina. " + text(rng, "en", 2), "en"), (text(rng, "en", 2) + " El frasco. " + text(rng, "en", 1), "en")]
    got = found(spark, rows)
    assert {k - n: v for k, v in got.items() if k >= n} == {0: [(1, "en"), (2, "es"), (3, "en")]}
    assert G.units("No. Ref. 12-A\n\nThis is a sentence of words. Do not. Use it now. Ok.") == ["this is a sentence of words.", "do not. use it now. ok."]
    assert G.units("No. Ref.") == ["no. ref."] and G.units("12-A") == G.units("") == []


def test_narrow_margins_are_rejected(spark):
    rng = random.Random(2)
    rows = [(text(rng, la), la) for la in sorted(FORMS) for _ in range(25)] + [("ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾᛁᛃ ᛇᛈᛉᛊᛏᛒ ᛖᛗᛚᛜᛞᛟ ᚠᚢᚦᚨᚱᚲᚷ ᚹᚺᚾᛁᛃ", None)]
    (last,) = [r for r in G.find(docs(spark, rows)).collect() if r["doc_id"] == len(rows) - 1]
    assert (last["seg"], last["lang"], last["confidence"]) == (1, None, 0.5)


def test_empty(spark):
    assert found(spark, []) == {}
    assert found(spark, [("some text without any label at all here.", None)]) == {}


def test_sample_is_bounded(spark):
    rng = random.Random(1)
    rows = [(text(rng, "en"), "en") for _ in range(60)]
    assert len(G.training_sample(docs(spark, rows), 7)) == 7
    assert len(G.training_sample(docs(spark, rows), 100)) == 60
