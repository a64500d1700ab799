import random

import pytest
from hypothesis import given, settings, strategies as st

from foldlake.llm import queries, surrogates
from foldlake.llm.surrogates import Cipher, find, luhn

KEY = b"a key of the tests"


def replaced(text, key=KEY):
    return surrogates.replaced(text, key)


def surrogate(kind, value, key=KEY):
    return surrogates.surrogate(kind, value, key)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.binary(min_size=1, max_size=4), st.integers(2, 7))
def test_the_permutation_keeps_values_apart_and_moves_them(size, key, step):
    own = Cipher(key)
    for fits in (lambda _: True, lambda v: v % step != 1):
        values = [v for v in range(size) if fits(v)]
        out = [own.walk(v, size, b"t", fits) for v in values]
        assert sorted(out) == values
        assert len(values) < 2 or all(a != b for a, b in zip(values, out, strict=True))


TEXT = (
    "Mrs. Anna Smith wrote to Herr Müller and Smith from +1 (659) 555-3949, jo.doe@mail5.example.com or JO@firm.co.uk; "
    "card 4111 1111 1111 1111 and 4785380592391139$$$, host 152.143.123.131###, 078-05-1120, DE89 3704 0044 0532 0130 00, г-жа Иванова."
)


def test_entities_go_and_formats_stay():
    new, spans = replaced(TEXT)
    assert len(new) == len(TEXT)
    assert [k for *_, k, _ in spans] == ["name", "name", "name", "name", "phone", "email", "email", "card", "card", "ip", "ssn", "iban", "name"]
    for a, b, kind, _ in spans:
        old, own = TEXT[a:b], new[a:b]
        assert own != old and len(own) == len(old)
        assert [c.isdigit() for c in old] == [c.isdigit() for c in own] and [c.isupper() for c in old] == [c.isupper() for c in own]
        if kind == "card":
            assert luhn(own) == luhn(old)
        if kind == "ip":
            assert all(0 <= int(o) < 256 and o == str(int(o)) for o in own.split("."))
        if kind == "iban":
            assert surrogates._iban_rest(own) == 1 and own[:2] == "DE"
    assert spans == find(new) or [s[:3] for s in spans] == [s[:3] for s in find(new)]


def test_names_keep_script_gender_and_reference():
    new, spans = replaced("Frau Erika Mustermann kam. Mustermann ging. г-жа Анна Иванова. Mr Bob.")
    words = new.replace(".", "").split()
    assert words[2] == words[4] and words[1].endswith("a")
    assert all("а" <= c <= "я" for c in words[7].lower() + words[8].lower()) and words[8].endswith("а")
    assert {g for *_, g in spans} == {"f", "m"}
    assert surrogate("name", "Mustermann") == words[2]


def test_equal_values_stay_equal_and_others_apart():
    rng = random.Random(1)
    for kind, make in {
        "card": lambda: "".join(rng.choice("0123456789") for _ in range(13)), "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "phone": lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", "email": lambda: f"{rng.choice('abc')}{rng.choice('xyz')}.{rng.randrange(100)}@m{rng.randrange(9)}.example.com",
    }.items():
        values = {make() for _ in range(1500)}
        out = {surrogate(kind, v) for v in values}
        assert len(out) == len(values)
        assert all(surrogate(kind, v) != v for v in values)
        assert surrogate(kind, min(values), b"another key") != surrogate(kind, min(values))


def test_clean_text_is_left_alone():
    for text in ("No. 12 in 2021, 3.14 and 1,000,000; see v1.2.3 or 10-20-30.", "a@b, @home, user@localhost", "Mister nobody, Mr. said it", "token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", ""):
        assert replaced(text) == (text, [])


NAMES = [
    ("Herr Müller und Frau Meier kamen.", ["Müller", "Meier"]),
    ("Mr. Smith and Mrs. Jones", ["Smith", "Jones"]),
    ("Mr. Smith Mrs. Jones", ["Smith", "Jones"]),
    ("MR. SMITH left", ["SMITH"]),
    ("Dr. Anna Berg spoke; later Berg left and Anna too.", ["Anna", "Berg", "Berg", "Anna"]),
    ("Prof. Dr. Hans von der Heide", ["Hans", "Heide"]),
    ("then Mary Jones came", ["Mary", "Jones"]),
    ("Sir Jean-Luc O’Neill", ["Jean", "Luc", "Neill"]),
    ("Señora García López y Sr. Pérez", ["García", "López", "Pérez"]),
    ("Mr. Smith. The end", ["Smith"]),
    ("Mr Smith The end", ["Smith"]),
]


@pytest.mark.parametrize(("text", "names"), NAMES)
def test_names_are_found_and_leave_the_text(text, names):
    new, spans = replaced(text)
    assert [text[a:b] for a, b, *_ in spans] == names
    assert not set(names) & set(surrogates._LETTERS.findall(new)) and len(new) == len(text)


def test_given_names_keep_their_gender():
    for gender, names in surrogates.GIVEN.items():
        own = names.split()
        listed = [n for n in own if len(surrogates._peers(n)) > 1]
        assert len(listed) > 0.8 * len(own)
        new = [surrogate("name", n) for n in listed]
        assert len(set(new)) == len(listed) and all(surrogates._GIVEN[n] == gender for n in new)
        assert [surrogate("name", n.upper()) for n in listed] == [n.upper() for n in new]
    rng = random.Random(5)
    others = {"".join(rng.choice("aeinrst") for _ in range(rng.randrange(3, 7))).capitalize() for _ in range(2000)} - set(surrogates._GIVEN)
    new = {surrogate("name", n) for n in others}
    assert len(new) == len(others) and not any(len(surrogates._peers(n)) > 1 for n in new)


def test_a_surrogate_never_stands_in_the_text():
    for value in ("Smith", "Jones", "Maier"):
        taken = surrogate("name", value)
        new, _ = replaced(f"Mr. {value} saw the {taken} there, and {value} left.")
        words = surrogates._LETTERS.findall(new)
        assert words[1] == words[7] and words[1] not in (value, taken) and words[4] == taken
    text = "Mr. Smith and Mr. " + surrogate("name", "Smith")
    words = surrogates._LETTERS.findall(replaced(text)[0])
    assert len({words[1], words[4], "Smith", surrogate("name", "Smith")}) == 4


def planted(rng):
    """A text, and its entities as they were put there."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(valid):
        while luhn(out := "4" + digits(15)) != valid:
            pass
        return out

    makers = {
        "email": lambda: f"{rng.choice(['jo', 'a.b', 'x-y'])}{digits(2)}@m{rng.randrange(10)}.{rng.choice(['example.com', 'firm.co.uk'])}",
        "phone": lambda: f"+1 ({rng.randrange(100, 999)}) 555-{digits(4)}", "card": lambda: card(rng.random() < 0.5),
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    people = [("Mr. ", "Smith"), ("Frau ", "Meier"), ("MRS. ", "JONES"), ("г-жа ", "Иванова"), ("Dr. ", "Weber")]
    filler = ["the", "house", "and", "green,", "été", "so.", "12.5", "Наш", "word", "&&&", "(see)"]
    text, found = "", []
    for _ in range(rng.randrange(1, 40)):
        text += rng.choice(filler) + rng.choice([" ", " ", "\n"])
        if rng.random() < 0.3:
            lead, kind = "", rng.choice([*makers, "name"])
            if kind == "name":
                lead, value = rng.choice(people)
            else:
                value = makers[kind]()
            text += lead
            found.append((len(text), len(text) + len(value), kind))
            text += value + rng.choice([" and ", ", ", "; "])
    return text, found


def test_planted_entities_against_what_was_planted():
    rng = random.Random(11)
    names: dict[str, str] = {}
    for _ in range(400):
        text, found = planted(rng)
        new, spans = replaced(text)
        assert [s[:3] for s in spans] == found
        at = 0
        for a, b, kind, _ in spans:
            assert text[at:a] == new[at:a] and text[a:b] != new[a:b]
            if kind == "card":
                assert luhn(text[a:b]) == luhn(new[a:b])
            assert names.setdefault((kind, text[a:b]), new[a:b]) == new[a:b]
            at = b
        assert text[at:] == new[at:]
    assert len(set(names.values())) == len(names)


def test_the_key_is_the_callers(spark, documents):
    with pytest.raises(TypeError):
        surrogates.replace(documents([]))
    own = queries.surrogate_key(spark)
    assert len(own) == 32 and queries.surrogate_key(spark) == own
    spark.conf.set(queries.KEY_SETTING, "given")
    assert queries.surrogate_key(spark) == b"given"
    spark.conf.unset(queries.KEY_SETTING)


def test_a_long_text_with_many_entities():
    text = " ".join(f"Mr. Smith{'abcdefghij'[i % 10]} at jo{i}@m.example.com" for i in range(20_000))
    new, spans = replaced(text)
    assert len(spans) == 40_000 and len(new) == len(text)


def test_rows_and_columns(documents, odd_rows):
    docs = documents([*odd_rows, (50, TEXT), (51, TEXT)])
    out = surrogates.replace(docs, KEY)
    assert out.columns == docs.columns
    before, after = docs.collect(), out.collect()
    for a, b in zip(before, after, strict=True):
        assert b.text == replaced(a.text)[0] and a.asDict() | {"text": 0} == b.asDict() | {"text": 0}
    got = {r.doc_id: r for r in surrogates.entities(docs, KEY).collect()}
    assert got[50].text == got[51].text and got[50].n_entities == 13 and got[50].n_email == 2
    assert got[1].text is None and got[1].n_entities == 0 and got[2].text == ""
    assert surrogates.entities(documents([]), KEY).collect() == [] and surrogates.replace(documents([]), KEY).collect() == []
