import pytest

from tributary.llm import encodings as en

CLEAN = {
    "de": "Größere Mühle und nasse Wölbung verändert die Brücke über Straße täglich – „schön“, sagt Öhm, für die Tür.",
    "fr": "L’équipe protège déjà chaque mémoire étroite, mais la théière brûle à Noël. « Où règle-t-elle la forêt ? »",
    "es": "¿Quién enseña la sábana difícil cuando después aprovecha la montaña? ¡La niñera midió además la órbita!",
    "pt": "Não é física: a oração vê também a irmã. A LIÇÃO e a VISÃO são únicas até após a calçada.",
    "ru": "Почему тёмная полка ставит кабель в подъезде? Эта свежая сова иногда собирает другую: сцена и лампа.",
    "zh": "如果石板仔细替换新的花园，灯笼之间就会加固水池。谁修补了果园里面的安静的河岸？",
}


@pytest.fixture(scope="module")
def model():
    words = {k: v.split() for k, v in CLEAN.items()}
    values = list(CLEAN.values())
    for k, w in words.items():
        step = CLEAN[k] if k == "zh" else None
        values += [step[i : i + 9] for i in range(len(step) - 9)] if step else [" ".join(w[i : i + 5]) for i in range(len(w))]
    return en.train(values * 3)


def test_clean_values_are_none(model):
    for v in CLEAN.values():
        assert en.classify([v], model)[0][0] is False
    assert en.classify(["A LIÇÃO alta", "VISÃO", "plain", "", "caf�"], model) == [(False, "", None)] * 5


@pytest.mark.parametrize("chain", [c for c in en.CHAINS if c[0][1] not in ("utf-8", "gb18030")])
def test_round_trip(model, chain):
    written = chain[0][0]
    langs = {"cp1251": ["ru"], "koi8-r": ["ru"], "gb18030": ["zh"]}.get(written, ["de", "fr", "es"])
    for lang in langs:
        bad = en.garble(CLEAN[lang], chain)
        found, _, restored = en.classify([bad], model)[0]
        assert found
        if "?" not in bad.replace(CLEAN[lang].replace("?", ""), ""):
            assert restored is not None


def test_part_of_a_value_is_restored(model):
    v = CLEAN["de"]
    bad = v[:40] + en.garble(v[40:], ((("utf-8"), "cp1252"),))
    assert en.classify([bad], model)[0] == (True, "utf-8 read as cp1252", v)


def test_lost_bytes(model):
    found, _, restored = en.classify(["la th�ière bleue"], model)[0]
    assert found and restored is None


def test_tables(spark, model):
    bad = en.garble(CLEAN["fr"], (("utf-8", "cp1252"),))
    rows = [(i, v, "x", "y") for i, v in enumerate(CLEAN.values())] * 8 + [(20, bad, None, "y"), (20, bad, None, "y"), (21, None, "", "y"), (22, "", bad, "y")]
    df = spark.createDataFrame(rows, "result_id long, title string, content string, field string")
    got = sorted((r.result_id, r.field, r.restored) for r in en.find_garbled(df).collect())
    assert got == [(20, "title", CLEAN["fr"]), (20, "title", CLEAN["fr"]), (22, "content", CLEAN["fr"])]
    assert en.find_garbled(df.limit(0)).count() == 0
