import random

import pytest

from geolattice.llm import pii


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to john.doe [at] example [dot] com now", [("john.doe [at] example [dot] com", "email", "john.doe@example.com")]),
        ("mail bob at example dot org please", [("bob at example dot org", "email", "bob@example.org")]),
        ("call five five five, zero one two three four five six ok", [("five five five, zero one two three four five six", "phone", "5550123456")]),
        ("＋1 (386) 555-3733", [("＋1 (386) 555-3733", "phone", "+13865553733")]),
        ("jоhn@exаmple.com", [("jоhn@exаmple.com", "email", "john@example.com")]),
        ("a​b@c­.com", [("a​b@c­.com", "email", "ab@c.com")]),
        ("card 4111 1111 1111 1111 and 4111 1111 1111 1112", [("4111 1111 1111 1111", "card", "4111111111111111")]),
        ("９.9.9.9 and 300.1.1.1", [("９.9.9.9", "ip", "9.9.9.9")]),
        ("SSN 123-45-6789.", [("123-45-6789", "ssn", "123-45-6789")]),
        ("IBAN DE89 3704 0044 0532 0130 00 here", [("DE89 3704 0044 0532 0130 00", "iban", "DE89370400440532013000")]),
        ("eins zwei drei vier fünf sechs sieben acht", [("eins zwei drei vier fünf sechs sieben acht", "phone", "12345678")]),
        ("Meet me at home. The dot is red. One two buckle my shoe; year 2024, 10 to 12", []),
        ("", []),
    ],
)
def test_finds(text, want):
    assert [(text[a:b], k, v) for a, b, k, v in pii.identifiers(text)] == want


def test_offsets_survive_disguises():
    """Identifiers put into texts at known places are found there, whatever the disguise."""
    rng = random.Random(2)
    masks = [lambda e: e, lambda e: e.replace("@", " [at] ").replace(".", " [dot] "), lambda e: e.replace("@", "(at)").replace(".", "(dot)"), lambda e: e.replace("o", "о").replace("a", "а"), lambda e: "​".join(e)]
    for _ in range(300):
        words = ["".join(rng.choice("bcdfghlmnr") + rng.choice("aeiou") for _ in range(3)) for _ in range(30)]
        secret = f"{rng.choice(words)}@{rng.choice(words)}.com"
        shown = rng.choice(masks)(secret)
        text = "é" + " ".join(words[:15]) + ", " + shown + "; " + " ".join(words[15:])
        assert [(text[a:b], v) for a, b, _, v in pii.identifiers(text)] == [(shown, secret)]


def test_trigger_misses_nothing():
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = ["x@y.com", "x ＠ y.com", "bob at example dot org", "bob [at] y [dot] com", "one two three four five six seven", "１２３-45-6789", "𝟗.9.9.9", "u_at_v_dot_com"]
    hit = pc.match_substring_regex(pa.array(texts), pii.TRIGGER).to_pylist()
    assert all(h or not pii.identifiers(t) for h, t in zip(hit, texts)) and all(hit[:7])


def test_table(spark, odd, docs):
    assert pii.find(odd).count() == 0
    assert pii.find(docs([])).count() == 0
    long = "word " * 200_000 + "a@b.com"
    rows = docs([(1, long), (2, "x@y.org"), (2, "x@y.org"), (None, "9.9.9.9"), (3, "x [at] y [dot] org")])
    got = sorted((str(r["doc_id"]), r["start"], r["kind"], r["value"], r["disguised"]) for r in pii.find(rows).collect())
    assert got == [("1", 1_000_000, "email", "a@b.com", False), ("2", 0, "email", "x@y.org", False), ("2", 0, "email", "x@y.org", False), ("3", 0, "email", "x@y.org", True), ("None", 0, "ip", "9.9.9.9", False)]


def test_find_sees_what_identifiers_sees(spark, docs):
    """Disguises that only show once look-alikes, invisible characters and wide blanks are gone."""
    want = ["jane [\u0430t] example [dot] com", "jane at example d\u043et com", "jane (a\u200bt) example (dot) com", "jane [\uff41\uff54] example [\uff44\uff4f\uff54] com", "jane\u00a0at\u00a0example\u00a0dot\u00a0com", "jane at example [.] com", "jane at example\ndot com", "jane\u3000at\u3000example dot com"]
    want += ["f\u0456ve f\u0456ve five zero one two three four", "five\u00a0five\u00a0five\u00a0zero\u00a0one\u00a0two\u00a0three", "f\u0131ve five five zero one two \u017feven"]
    want += ["\u09e7\u09e8\u09e9-\u09ea\u09eb\u09ec-\u09ed\u09ee\u09ef\u09e6"]
    assert all(pii.identifiers(t) for t in want)
    plain = ["caf\u00e9 \u2013 at the end\u00a0of it", "meet at the end of the road"]
    got = {r["doc_id"] for r in pii.find(docs(list(enumerate(want + plain)))).collect()}
    assert got == set(range(len(want)))


AT = ["@", " @ ", "[at]", " [at] ", "(at)", " (AT) ", "{ at }", "<at>", " at ", "[@]", "-at-", "_at_", " arroba "]
DOT = [".", "[dot]", " [dot] ", "(dot)", " dot ", " DOT ", "{.}", "[.]", "_dot_", "-dot-", " punkt "]


def _some(rng, text, table, share=0.5):
    return "".join(table.get(c, c) if rng.random() < share else c for c in text)


_WIDE = {chr(0x21 + k): chr(0xFF01 + k) for k in range(94)}
_MATH = {chr(97 + k): chr(0x1D41A + k) for k in range(26)} | {str(k): chr(0x1D7CE + k) for k in range(10)}
_CYRILLIC = dict(zip("aeiopcyxs", "аеіорсухѕ"))
MASKS = {
    "none": lambda rng, x: x,
    "cyrillic": lambda rng, x: _some(rng, x, _CYRILLIC),
    "wide": lambda rng, x: _some(rng, x, _WIDE),
    "math": lambda rng, x: _some(rng, x, _MATH),
    "invisible": lambda rng, x: "".join(c + (rng.choice("​‌⁠­") if rng.random() < 0.3 else "") for c in x),
    "blanks": lambda rng, x: "".join(rng.choice("   ") if c == " " else c for c in x),
    "lines": lambda rng, x: x.replace(" ", "\n", 1),
    "case": lambda rng, x: "".join(c.upper() if rng.random() < 0.5 else c for c in x),
    "dotless": lambda rng, x: x.replace("i", "ı"),
}


def disguised(seed):
    """Each way to write an address or a number, behind each two masks."""
    rng = random.Random(seed)
    plain = [f"jim.cox{a}data{d}mail{d}org" for a in AT for d in DOT] + [f"kim{a}site{d}com" for a in AT for d in DOT]
    plain += ["five five five zero one two three four", "eins zwei, drei vier (fünf) sechs sieben", "+1 386 555 3733", "4111 1111 1111 1111", "123-45-6789", "10.20.30.40", "DE89 3704 0044 0532 0130 00", "uno dos tres 4 5 6 siete"]
    return [f"été, {MASKS[b](rng, MASKS[a](rng, p))}; end" for p in plain for a in MASKS for b in MASKS]


def test_every_disguise_with_every_other(spark, docs):
    """The rows that find() judges are all that hold an identifier, and nearly all of these disguises are seen through."""
    import pyarrow as pa

    from geolattice.llm._text import texts_of

    texts = disguised(1)
    want = {k: [(a, z, kind, v) for a, z, kind, v in pii.identifiers(t)] for k, t in enumerate(texts)}
    holding = {k for k, v in want.items() if v}
    missed = holding - set(pii.suspects(texts_of(pa.array(texts, pa.large_string()))).tolist())
    assert not missed, [texts[k] for k in sorted(missed)[:5]]
    assert len(holding) >= 0.97 * len(texts), [t for k, t in enumerate(texts) if k not in holding][:10]
    got = {}
    for r in pii.find(docs(list(enumerate(texts)))).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["kind"], r["value"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_values_behind_any_two_disguises():
    """Whatever hides an address, the value is the address and the span is what was written (without invisible characters after it)."""
    rng = random.Random(3)
    for a in MASKS:
        for b in MASKS:
            shown = MASKS[b](rng, MASKS[a](rng, "jim.cox [at] data [dot] mail [dot] org"))
            text, shown = f"été, {shown}; end", shown.rstrip(pii._INVISIBLE)
            assert [(text[x:y], v) for x, y, _, v in pii.identifiers(text)] == [(shown, "jim.cox@data.mail.org")], (a, b, text)
