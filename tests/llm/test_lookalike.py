import pytest
import regex

from codeloom.llm.lookalike import Normalizer, look_classes, lookalike_pairs, lookalikes, looks, normalized

SCHEMA = "doc_id bigint, text string, text_hash string, look_hash int, rep string, other int"


@pytest.fixture(scope="module")
def form(spark):
    return Normalizer(lookalikes(spark)).text


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in enumerate(texts)], SCHEMA)


SAME = [
    ("abc", "\uff41\uff42\uff43"), ("caf\u00e9", "cafe\u0301"), ("a b", "a\u00a0b"), ("a b", "a\u202fb"), ("a b", "a\u2007b"), ("ab", "a\u200bb"), ("ab", "a\u00adb"), ("ab", "\ufeffab"), ("a-b", "a\u2011b"), ("fix flow off", "\ufb01x \ufb02ow o\ufb00"),
    ("scope", "s\u0441op\u0435"), ("HOT", "\u041d\u039f\u0422"), ("\u0440\u0430\u0431\u043e\u0442\u0430", "\u0440a\u0431o\u0442a"), ("a;", "a\u037e"), ("10K", "10\u212a"), ("\u043a\u0438\u0439", "\u043a\u0438\u0438\u0306"), ("\u00b5m", "\u03bcm"), ("\u0451", "\u00eb"), ("BPD", "\ua4d0\ua4d1\ua4d3"), ("KEY", "\ua4d7\ua4f0\ua4ec"),
]
OTHER = [("cafe", "caf\u00e9"), ("a", "A"), ("x2", "x\u00b2"), ("1", "l"), ("O", "0"), ("ab", "a b"), ("a  b", "a b"), ("rn", "m"), ("it's", "it\u2019s"), ("\u30c8", "\u30c9"), ("s", "\u017f"), ("\U0001f468\u200d\U0001f469", "\U0001f468\U0001f469")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(form, a, b):
    assert form(a) != form(b)


def test_tokens_keep_to_one_script(form):
    assert form("\u0440a\u0431o\u0442a") == "\u0440\u0430\u0431\u043e\u0442\u0430"
    assert form("\u0441op") == "cop"
    assert not regex.search(r"\p{Cyrillic}", form("s\u0441\u043epe of \u0430 token"))


def test_the_form_is_stable(form):
    for a, b in SAME + OTHER:
        assert form(form(a)) == form(a) and form(form(b)) == form(b)


def brute(form, texts):
    seen = [(i, t, form(t)) for i, t in enumerate(texts) if t and regex.search(r"[^\s\p{Z}\p{C}]", t)]
    return sorted((i, j) for k, (i, a, x) in enumerate(seen) for j, b, y in seen[k + 1 :] if x == y and a != b)


def test_pairs(spark, form):
    texts = ["scope", "sc\u043epe", None, "", " ", "\u00a0", "\u200b", "scop\u0435", "other", "x" * 200_000, "x" * 199_999 + "\u0445", "caf\u00e9", "cafe\u0301"]
    assert sorted(map(tuple, lookalike_pairs(looks(docs(spark, texts))).collect())) == brute(form, texts)


def test_copies_link_to_each_other_text_once(spark, rows):
    got = rows(lookalike_pairs(looks(docs(spark, ["ab", "a\u200bb", "ab", "ab", "zz", "zz"]))))
    assert got == [(0, 1), (1, 2), (1, 3)]
    assert rows(look_classes(looks(docs(spark, ["ab", "a\u200bb", "ab"]))), "rep", "copies") == [(0, 2), (1, 1)]


def test_empty_and_null(spark, rows):
    assert lookalike_pairs(looks(docs(spark, []))).collect() == []
    assert rows(normalized(docs(spark, [None, "", "\uff41"]))) == [(0, None), (1, ""), (2, "a")]


#: Cyrillic and Greek letters that look alike, but like no ASCII letter.
SHARED = [("\u0413", "\u0393"), ("\u0424", "\u03a6"), ("\u041f", "\u03a0"), ("\u041b", "\u039b"), ("\u043a", "\u03ba"), ("\u0444", "\u03c6"), ("\u043f", "\u03c0")]


@pytest.mark.parametrize(("cyrillic", "greek"), SHARED)
def test_letters_shared_by_two_other_scripts(spark, form, cyrillic, greek):
    # a word with a letter that only Cyrillic has, one with a letter that only Greek has, and the letter alone
    assert form(greek + "\u0436\u0431") == form(cyrillic + "\u0436\u0431") == cyrillic + "\u0436\u0431"
    assert form(cyrillic + "\u03be\u03b4") == form(greek + "\u03be\u03b4") == greek + "\u03be\u03b4"
    assert form(greek) == form(cyrillic) == cyrillic
    for t in (greek + "\u0436\u0431", cyrillic + "\u03be\u03b4", cyrillic, greek + cyrillic + "az"):
        assert form(form(t)) == form(t)
    texts = [f"\u0436\u0431{cyrillic} x", f"\u0436\u0431{greek} x", f"\u0436\u0431{cyrillic.swapcase()} x"]
    assert sorted(map(tuple, lookalike_pairs(looks(docs(spark, texts))).collect())) == [(0, 1)]
