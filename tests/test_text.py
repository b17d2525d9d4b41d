import unicodedata

from pyspark.sql import functions as F

from voxloom.functions import text


def test_normalize(col):
    got = col(text.normalize_for_eval, ["¡Hola, Doña María! ¿Qué tal?", "Hola [risas] amigo [susp] mío.", None, "pa'lante 'algo' it's", "[NEGACIÓN] ya", "a b", unicodedata.normalize("NFD", "Él está")])
    assert got == ["hola doña maría qué tal", "hola amigo mío", "", "pa'lante algo it's", "ya", "a b", "él está"]


def test_post_edit_keeps_case(col):
    assert col(text.post_edit_raw, ["“Hola” — ‘Eh’ {{x}} (( y )) <z>", None]) == ["\"Hola\" - 'Eh'", ""]


def test_markup(col):
    got = col(text.clean_markup, ["sí [HS:E1 no [Asent].] ya", "[HX: abierto", "año=niño x", "me·sa a=b=c [RISAS]", None])
    assert got == ["sí ya", "abierto", "niño x", "mesa b=c", ""]


def test_tokens_have_no_empty_word(col):
    assert col(text.tokens, ["", " a  b ", None]) == [[], ["a", "b"], []]
    assert col(text.word_tokens, ["¡Pa'lante, Ñu_2!"]) == [["pa'lante", "ñu_2"]]


def test_accents_and_names(col):
    assert col(text.accent_key, ["Latin American", "Castilian-Spanish", "", None]) == ["latin_american", "castilian_spanish", "_", "_"]
    assert col(text.stem_prefix, ["/d/rec1__003.wav", "rec2.txt"]) == ["rec1", "rec2"]
    assert col(text.hms_seconds, ["1:02:03"]) == [3723.0]


def test_dialect(col):
    rules = [
        text.DialectRule("para", ("pa",), "word_whole"),
        text.DialectRule("ido", ("ío",), "word_suffix"),
        text.DialectRule("ado", ("ao",), "word_suffix"),
        text.DialectRule("donde", ("onde",), "word_whole", ("AST",)),
    ]
    in_ast = lambda c: text.dialect_to_canonical(c, F.lit("AST"), rules)
    in_mad = lambda c: text.dialect_to_canonical(c, F.lit("MAD"), rules)
    assert col(in_ast, ["voy pa casa", "comío y pesao", "onde está"]) == ["voy para casa", "comido y pesado", "donde está"]
    assert col(in_mad, ["onde está"]) == ["onde está"]
    assert col(lambda c: text.canonical_to_dialect(c, F.lit("MAD"), rules), ["voy para casa"]) == ["voy pa casa"]


def test_stable_fraction(col):
    import hashlib

    want = int(hashlib.sha1(b"7:abc").hexdigest()[:12], 16) / 0xFFFFFFFFFFFF
    assert col(lambda c: text.stable_fraction(c, 7), ["abc"]) == [want]


def test_open_markup_before_a_long_text(col):
    long = "palabra " * 40_000
    assert col(text.clean_markup, [f"a [HS:E1 {long}", f"a [HS:E1 {long}[b] {long}] c"]) == [f"a E1 {long}".strip(), "a c"]
