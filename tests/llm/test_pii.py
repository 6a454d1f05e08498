import random
import re

from cardloom.llm import pii


def test_types_formats_and_coreference(spark):
    text = "Mail und.34@mail7.example.com or UND.34@mail7.example.com, call +1 (017) 555-7713 or +10175557713, pay 4111 1111 1111 1111, from 97.51.17.173 and 10.0.0.7, SSN 123-45-6789. Frau Anna Schmidt met Mr. Paul Smith; Mrs Иванова. Dr. x"
    rows = [(1, text, "en"), (2, text.replace("97.51", "96.51"), "en"), (None, None, None), (3, "", "de"), (4, "no entity here 12 345", "fr"), (1, text, "en")]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, lang string"), b"k", spans=True).collect()
    by = {r.doc_id: r for r in got}
    one, two = by[1], by[2]
    assert (one.n_email, one.n_phone, one.n_card, one.n_ip, one.n_ssn, one.n_name) == (2, 2, 1, 2, 1, 3)
    for s in ("und.34@mail7", "555-7713", "4111 1111", "97.51.17.173", "10.0.0.7", "123-45-6789", "Schmidt", "Smith", "Иванова"):
        assert s not in one.text
    mails = re.findall(r"\S+@\S+\.com", one.text)
    assert mails[0].lower() == mails[1].lower() and mails[1].split("@")[0].isupper()
    phones = re.findall(r"\+1[ ()\d-]+", one.text)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0].strip())
    card = re.search(r"pay ([\d ]+),", one.text)[1]
    assert pii.luhn(card) and re.fullmatch(r"(\d{4} ){3}\d{4}", card)
    a, b = re.findall(r"\d+\.\d+\.\d+\.\d+", one.text), re.findall(r"\d+\.\d+\.\d+\.\d+", two.text)
    assert a[0] != b[0] and a[1] == b[1] and a[1].startswith("10.")
    first = re.search(r"Frau (\w+) ", one.text)[1]
    assert first in pii.GIVEN["latin", "f"] and re.search(r"Mr\. (\w+) ", one.text)[1] in pii.GIVEN["latin", "m"]
    assert re.search(r"Mrs ([а-яА-Я]+)\.", one.text)
    assert one.text.replace(a[0], "") == two.text.replace(b[0], "")
    assert by[4].text == "no entity here 12 345" and by[3].text == "" and by[None].text is None and len(got) == 6
    assert [e.kind for e in one.entities][:2] == ["email", "email"]


def test_surrogates_are_one_to_one():
    s = pii.Surrogates(b"k")
    ips = {s.of("ip", f"8.8.{i}.{j}") for i in range(20) for j in range(50)}
    mails = {s.of("email", f"{a}{b}.{i}@x.org") for a in "abé" for b in "xyz" for i in range(100)}
    cards = {s.of("card", f"{4_000_000_000_000_000 + i}") for i in range(1000)}
    people = {*pii.GIVEN["latin", "f"], *(f"{a}{b}na" for a in "BCDFGHKLMNPRSTVW" for b in "aeiouy")}
    names = {s.of("name", f"Ms. {n} Li") for n in people}
    assert (len(ips), len(mails), len(cards), len(names)) == (1000, 900, 1000, len(people))
    assert {s.of("ssn", f"000-00-{i:04}") for i in range(50)} != {pii.Surrogates(b"other").of("ssn", f"000-00-{i:04}") for i in range(50)}
    for n in (1, 2, 10, 26, 1000):
        assert sorted(s.permute(x, n, "t") for x in range(n)) == list(range(n))


def test_no_surrogate_is_its_original():
    for key in (b"k", b"cardloom", b"other"):
        s = pii.Surrogates(key)
        for n in (2, 3, 8, 20, 1000):
            assert sorted(got := [s.permute(x, n, "t") for x in range(n)]) == list(range(n)) and all(x != y for x, y in enumerate(got))
            even = [s.permute(x, n, "e", lambda y: y % 2 == 0) for x in range(0, n, 2)]
            assert sorted(even) == list(range(0, n, 2)) and (n < 3 or all(x != y for x, y in zip(range(0, n, 2), even, strict=True)))
        for names in pii.GIVEN.values():
            assert all(s._word(x) != x for x in names)


def test_shape_keeps_shapes_apart():
    s = pii.Surrogates(b"k")
    words = {w for a in "aeb1" for b in "ic2é" for w in (a + b,)}
    assert len({s.shape(w, "t") for w in words}) == len(words)


def test_empty_and_clash(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pseudonymise(docs, b"k").count() == 0
    clash = spark.createDataFrame([("a@b.org", "old", 1)], "text string, n_email string, entities int")
    got = pii.pseudonymise(clash, b"k").first()
    assert got.n_email == 1 and got["entities"] == 1 and got.text != "a@b.org"
    assert pii.pseudonymise(clash, b"k", spans=True).first()["entities"][0].kind == "email"


def everyone():
    return [n for names in pii.GIVEN.values() for n in names]


def test_words_of_names_are_one_to_one_and_keep_list_script_and_gender():
    rng = random.Random(1)
    for key in (b"k", b"another"):
        s = pii.Surrogates(key)
        others = {"".join(rng.choice(a) for a in ("BDGKLMNPRST", "aeio", "lmnrst", "aeio", "nst")) for _ in range(3000)} - set(everyone())
        for kind, names in pii.GIVEN.items():
            assert sorted(map(s._word, names)) == sorted(names), kind
        got = {s._word(w) for w in others}
        assert len(got) == len(others) and not got & set(everyone())
        assert all(w[-1] == s._word(w)[-1] and s._word(w)[0].isupper() for w in list(others)[:200])


def test_a_person_stays_one_in_full_and_by_one_word():
    s = pii.Surrogates(b"k")
    first, last = s.of("name", "Mr. Paul Smith").split(" ")[1:]
    assert s.of("name", "Mr. Paul") == f"Mr. {first}" and s.of("name", "Dr. Smith") == f"Dr. {last}" and s.of("name", "MR. PAUL SMITH".replace("MR.", "Mr.")) == f"Mr. {first.upper()} {last.upper()}"
    assert len({s.of("name", f"Mr. {n}") for n in ("Leon", "Waig", "Nina", "Wada", "Adam", "Isyc")}) == 6


def test_phones_in_any_notation_are_one():
    s = pii.Surrogates(b"k")
    digits = {re.sub(r"[^0-9]", "", s.of("phone", p))[-10:] for p in ("+1 (017) 555-7713", "+10175557713", "(017) 555-7713", "017-555-7713", "+1 017.555.7713")}
    assert len(digits) == 1 and digits != {"0175557713"}
    assert s.of("phone", "+49 30 1234567").startswith("+49 ") and s.of("phone", "+353 1 234 5678").startswith("+353 ")


def mod97(text):
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def test_ibans_stay_valid_or_invalid():
    s = pii.Surrogates(b"k")
    for iban in ("GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606"):
        new = s.of("iban", iban)
        assert mod97(iban) == mod97(new) == 1 and new != iban and new[:2] == iban[:2] and re.sub("[0-9]", "0", new).count("0") == re.sub("[0-9]", "0", iban).count("0")
        assert s.of("iban", iban.replace(" ", "")) == new.replace(" ", "")
        wrong = f"{iban[:2]}{(int(iban[2:4]) + 1) % 100:02}{iban[4:]}"
        assert mod97(s.of("iban", wrong)) != 1
    assert len({s.of("iban", f"DE89{i:018}") for i in range(2000)}) == 2000


def test_names_without_title_and_in_other_scripts():
    text = "Anna Schmidt saw Łukasz. Mr. Żółkiewski, Mr. 王伟, Frau Çelik and emma came; Anna was late"
    new, found = pii.replace(text, pii.Surrogates(b"k"))
    assert [text[a:b] for a, b, _ in found] == ["Anna Schmidt", "Mr. Żółkiewski", "Mr. 王伟", "Frau Çelik"]
    assert not any(x in new for x in ("Schmidt", "Żół", "王伟", "Çelik")) and "Łukasz" in new and "emma" in new
    assert all(len(c.upper()) == 1 and c.upper().lower() == c for a in pii._ALPHABETS[1:15] for c in a)


def test_long_texts_and_texts_between_entities(spark):
    text = "x " * 200_000 + "a.b@c.org " + "" + "y " * 200_000
    rows = [(1, text), (2, ""), (3, None), (4, "a.b@c.org")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    assert len(got[1]) == len(text) and got[1].split()[200_000] == got[4] != "a.b@c.org" and got[2] == "" and got[3] is None


def test_session_key(spark):
    assert pii.session_key(spark) != pii.session_key(spark)
    spark.conf.set("spark.cardloom.pii.key", "s")
    try:
        assert pii.session_key(spark) == pii.session_key(spark)
    finally:
        spark.conf.unset("spark.cardloom.pii.key")


MEMBERS = {
    "email": ["anna.k@example.com", "Bob_7@mail.example.org"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"],
    "ip": ["97.51.17.173", "10.0.0.7"],
    "card": ["4111 1111 1111 1111", "5500005555555559"],
    "ssn": ["123-45-6789"],
    "phone": ["+49 30 5557713", "(017) 555-7713", "555-867-5309"],
    "name": ["Mr. Smith", "Frau Anna Schmidt", "Herr Prof. Dr. Weber", "Mrs. Mary J. Jones", "Lena Fischer", "M. Dupont", "Г-н Петров", "Κύριος Παύλου"],
}
JOINERS = [" at ", " and ", " or ", ", ", "; ", ". ", "\n", " ("]


def brute(text):
    """Kind by kind at every place, restarting where an entity ends."""
    patterns = {k: re.compile(p) for k, p in pii.PATTERNS.items()}
    at, out = 0, []
    while at < len(text):
        for kind, pattern in patterns.items():
            m = pattern.match(text, at)
            if not m and kind == "email" and out and out[-1][1] == at:
                m = re.compile(r"[\w.+%-]+@(?:[\w-]+\.)+[A-Za-z]{2,24}").match(text, at)
            end = at + (pii.name_end(m[0]) if kind == "name" else len(m[0])) if m else at
            if m and end > at:
                out.append((at, end, kind))
                at = end
                break
            if m:  # a name that is none: no later kind begins here
                at += m[0].index(" ")
                break
        else:
            at += 1
    return out


def test_entities_next_to_each_other_all_go():
    s = pii.Surrogates(b"k")
    for a, ones in MEMBERS.items():
        for b, others in MEMBERS.items():
            for joiner in JOINERS:
                for one in ones:
                    for two in others:
                        text = f"so {one}{joiner}{two} left"
                        found = pii.entities(text)
                        spans = [(text[x:y], k) for x, y, k in found]
                        assert spans == [(one, a), (two, b)], (text, spans)
                        new, _ = pii.replace(text, s)
                        assert new.startswith("so ") and new.endswith(" left") and joiner in new
                        for whole in (one, two):
                            core = [w for w in whole.split(" ") if w not in pii.TITLES]
                            assert " ".join(core) not in new


def test_search_equals_brute_force():
    rng = random.Random(9)
    bits = [*(x for v in MEMBERS.values() for x in v), "Mr. at", "Anna went", "Dr.", "Frau", "Paul", "foo", "12 345", "@", "a@b", "1.2.3", "+1", " and ", ", ", " ", " ", ".", "-", "Ms. Li Mrs. Wu", "x.y@z.org9", "Señor"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 9)))
        assert pii.entities(text) == brute(text), text
