import pytest

from ledgerloom.llm.names import core, lcs, relation


@pytest.mark.parametrize(("name", "form"), [
    ("SQ *NIREKLEKLEN PLUMBING & HEATING", "nirekleklen plumbing heating"), ("TST*  Zathadotra Roofing Contrs 1400", "zathadotra roofing contrs"), ("Lindry: Refegrosis Mfg", "refegrosis mfg"),
    ("Nirekleklen  Plumbing & Heating - Oxmoor Bend", "nirekleklen plumbing heating"), ("POS Nirekleklen Plumbing & Heating TERMINAL 21", "nirekleklen plumbing heating"), ("DonemechenCoffeeRoasters", "donemechen coffee roasters"),
    ("Nirékleklen Bakery Inc.", "nirekleklen bakery"), ("Virginia A. Jazevemos", "virginia jazevemos"), ("M. GABROSHESHE", "m gabrosheshe"), (None, ""), ("", ""), (" -- ", ""), ("LLC", "llc"), ("7", "7"),
])
def test_core(name, form):
    assert core(name) == form


@pytest.mark.parametrize(("a", "b", "kind"), [
    ("stapevegro bakery", "stapevergo bakery", "strong"), ("nirekleklen plumbing heating", "nirekleklen plbg htg", "strong"), ("plumbing heating nirekleklen", "nirekleklen plumbing heating", "strong"),
    ("tony nizichagim", "anthony nizichagim", "strong"), ("kikebranaautorepair", "kikebrana auto repair", "strong"), ("klechethashammfg", "klechethasham manufacturing", "weak"), ("m gabrosheshe", "margaret gabrosheshe", "weak"),
    ("zadrenotrem seafood", "zadrenotrem seafood market", "weak"), ("zadrenotrem insurance agency", "zadrenotrem seafood market", None), ("harold pezibeke", "lawrence pezibeke", None), ("robert rotresathes", "rotresathes coffee roasters", None),
])
def test_relation(a, b, kind):
    assert (relation(a, b) or (None,))[0] == kind == (relation(b, a) or (None,))[0]


def test_lcs_against_brute_force():
    from functools import cache

    def brute(a, b):
        @cache
        def f(i, j):
            if i == len(a) or j == len(b):
                return 0
            return 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

        return f(0, 0)

    words = ["", "a", "abcab", "bakery", "bakeri", "manufacturing", "mfg", "nirekleklen", "noreklekeln"]
    assert all(lcs(a, b) == brute(a, b) for a in words for b in words)
