import random

from gleaner.llm import garbled

FR = "L’équipe a noté que la procédure préfère le relevé malgré l’état dégradé. Voilà pourquoi la règle sépare les entrées après la mise à jour. "
FR2 = FR[FR.index("Voilà") :] + "La procédure préfère le relevé dès que la clé est chiffrée. "
DE = "Für den Schlüssel gilt: die Änderung löscht täglich zwölf Blöcke, während der Prüflauf übermäßig lange läuft. "
RU = "После сбоя каталог удаляет канал, поэтому вектор снова пуст. Важно: порог не устарел, когда запрос читает документ. "
TREE = "├── vault.missing_limiter\n│   └── schema.elastic_envelope\n± prompt.expired\n√ bloom.idle\n™ cache.orphaned\n"
CAPS = "APRÈS LA MISE À JOUR, LA TÂCHE COMPLÈTE LES ENTRÉES. ПОСЛЕ СБОЯ КАТАЛОГ УДАЛЯЕТ КЭШ. "


def wrong(text, written, read):
    raw = text.encode(written)
    return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


CLEAN = [(i, t) for i, t in enumerate([FR, DE, RU, TREE, CAPS, "plain ASCII only", "", None, FR + TREE, "price 170 € at 45 °C • ok ✅ ‘x’ “y” – z… ¿qué? ¡así! ñandú corazón", FR * 3, DE * 3, RU * 3, CAPS * 2] * 6)]
BAD = {
    1000: (wrong(FR, "utf-8", "cp1252"), FR), 1001: (wrong(DE, "utf-8", "latin-1"), DE), 1002: (wrong(wrong(FR, "utf-8", "cp1252"), "utf-8", "cp1252"), FR),
    1003: (wrong(FR, "utf-8", "mac_roman"), FR), 1004: (wrong(DE, "utf-8", "cp437"), DE), 1005: (wrong(RU, "utf-8", "cp1251"), RU), 1006: (wrong(RU, "koi8_r", "cp1251"), RU), 1007: (wrong(RU, "cp1251", "cp1252"), RU),
    1008: (wrong(RU, "cp1251", "cp866"), RU), 1009: (wrong(FR2, "latin-1", "cp437"), FR2), 1010: ("It didn\x92t \x93work\x94 \x96 at all", "It didn’t “work” – at all"), 1011: (FR + TREE + wrong(DE, "utf-8", "cp1252"), FR + TREE + DE),
}


def test_found_and_restored(spark, cluttered):
    rows = CLEAN + [(i, t) for i, (t, _) in BAD.items()] + [(2000, FR.encode("latin-1", "replace").decode("utf-8", "replace"))]
    got = {r.doc_id: r for r in garbled.garbled(cluttered(table(spark, rows))).collect()}
    assert set(got) == set(BAD) | {2000}
    for i, (_, text) in BAD.items():
        assert got[i].restored and got[i].text == text, i
    assert not got[2000].restored and got[2000].text == rows[-1][1]


def test_spans_are_offsets(spark):
    text = "Clean étude here. " + wrong(DE, "utf-8", "cp1252") + "Ende für heute."
    rows = CLEAN + [(1, text)]
    r = [x for x in garbled.garbled(table(spark, rows)).collect() if x.text.startswith("Clean")][0]
    assert r.text == "Clean étude here. " + DE + "Ende für heute."
    assert [s.pair for s in r.spans] == ["utf-8>cp1252"] and text[r.spans[0].begin :].startswith("Ã¼r den")


def test_inverse_round_trip():
    """Every pair undoes what it did, for letters that its encodings can write and read."""
    for pair, inverse in zip(garbled.PAIRS, garbled.inverses()):
        letters = "’“–€" if pair == ("cp1252", "latin-1") else "привет" if pair[0] in ("koi8_r", "cp866", "cp1251") else "日本語" if pair[0] in ("euc_jp", "gb18030") else "éèàçöüñóâî"
        undone = 0
        for word in [*letters, letters[:4]]:
            try:
                bad = word
                for n, read in enumerate(pair[1:]):
                    bad = wrong(bad, pair[0] if n == 0 else "utf-8", read)
            except UnicodeEncodeError:
                continue
            if bad.isascii() or any(c < "\x80" for c in bad):  # a reading that has ASCII characters isn't one run
                continue
            assert inverse(bad) == word or bad == word, (pair, word, bad)
            undone += bad != word
        assert undone, pair


def test_clean_and_garbled_letters_in_one_run(spark):
    mixed = "Die Größe ist groß, die Änderung löscht täglich. " * 2
    bad = {1: "Die grö" + wrong("ß", "utf-8", "cp1252") + "e Änderung lö" + wrong("ß", "utf-8", "cp1252") + "t. " + DE, 2: FR + "l’été" + wrong("à é", "utf-8", "cp1252") + " fin"}
    want = {1: "Die größe Änderung lößt. " + DE, 2: FR + "l’étéà é fin"}
    rows = [(i + 100, t) for i, (_, t) in enumerate(CLEAN)] + [(900, mixed)] + list(bad.items())
    got = {r.doc_id: r for r in garbled.garbled(table(spark, rows)).collect()}
    assert set(got) == {1, 2} and all(got[i].text == want[i] for i in want)


def test_nothing_to_do(spark):
    assert garbled.garbled(table(spark, [])).count() == 0
    assert garbled.garbled(table(spark, [(1, None), (2, ""), (3, "ascii")])).count() == 0
    assert garbled.garbled(table(spark, [(1, "ok é" + "x" * 300000)] + CLEAN)).count() == 0
