import hashlib
import random
import re
from datetime import date, timedelta

import pytest

from ledgerlark.llm import pii

KEY = "k'ey"
TEXTS = [
    None, "", "no values here", "mail the.72@mail3.example.com### and 4539578763621486!! or 4539 5787 6362 1486", "bad card 4539578763621487 stays",
    "ip 152.143.123.131### not 152.143.123.331 nor 1.2.3.4.5", "call +1 (017) 555-7713%%% or (212) 555-0187", "born 1984-02-29, 02/29/1984, 29.02.1984; not 1983-02-29 or 02/30/1984",
    "ssn 123-45-6789 not 666-45-6789 nor 123-00-6789", "iban DE89370400440532013000 not DE89370400440532013001", "x" * 200_000 + " 4539578763621486",
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


@pytest.fixture(scope="module")
def done(spark):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "kept")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pii string")
    once = pii.pseudonymise(docs, KEY)
    return docs, once, once.collect()


def test_kinds_and_formats(done):
    _, _, rows = done
    assert [r.text for r in rows[:3]] == [None, "", "no values here"] and all(r.pii == [] for r in rows[:3])
    kinds = [[x.kind for x in r.pii] for r in rows]
    assert kinds[3:] == [["email", "card", "card"], [], ["ip"], ["phone", "phone"], ["date"] * 3, ["ssn"], ["iban"], ["card"], ["email", "card", "card"]]
    assert rows[4].text == TEXTS[4]
    assert re.fullmatch(r"mail [a-z]{3}\.\d\d@mail3\.example\.com### and \d{16}!! or \d{4} \d{4} \d{4} \d{4}", rows[3].text)
    one, two = (x.value.replace(" ", "") for x in rows[3].pii[1:])
    assert one == two and luhn(one) and one != "4539578763621486" and rows[10].pii[0].value == one and rows[11].text == rows[3].text
    assert all(int(o) < 256 for o in rows[5].pii[0].value.split(".")) and "152.143.123.331 nor 1.2.3.4.5" in rows[5].text
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}%%% or \(\d{3}\) \d{3}-\d{4}", rows[6].text)
    iso, us, dotted = (x.value for x in rows[7].pii)
    y, m, d = iso.split("-")
    assert date.fromisoformat(iso) and us == f"{m}/{d}/{y}" and dotted == f"{d}.{m}.{y}" and "not 1983-02-29 or 02/30/1984" in rows[7].text
    area, group, serial = map(int, rows[8].pii[0].value.split("-"))
    assert area not in (0, 666) and area < 900 and group and serial
    account = rows[9].pii[0].value
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def test_round_trip(done):
    docs, once, _ = done
    assert [r.text for r in pii.pseudonymise(once, KEY, back=True).collect()] == [r.text for r in docs.collect()]


def test_permutes_whole_domain(spark):
    cipher = pii.Cipher(KEY)
    got = spark.range(12 * 7).selectExpr("id", f"{cipher.number('id', 12, 7, 'x')} as y").collect()
    assert sorted(r.y for r in got) == list(range(84)) and [r.y for r in got] != list(range(84))


def test_empty_table(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id bigint, text string"), KEY).collect() == []


def test_cards_next_to_numbers(spark):
    rng = random.Random(5)
    card, spaced, odd = "4539578763621486", "4539 5787 6362 1486", "45395787 63621486"
    longer = next(f"{card} {n}" for n in range(100, 1000) if luhn(f"{card}{n}"))
    texts = [
        f"card {card} 12/27", f"flat 7 {card}.", f"{spaced} 12/27", f"{spaced} 123", f"year 2024 {spaced} 12/27 {card}", f"{spaced.replace(' ', '-')} 99", f"pay {longer} now",
        f"{odd} {card}", f"{card} 1984-02-29", f"{card} 10.0.0.1", f"{card} 12@mail.com", "3782 822463 10005 11/26", f"{card} {card} {spaced}", "1 2 3 4 5 6 7 8 9 " * 3000,
    ]
    want = [1, 1, 1, 1, 2, 1, 1, 2, 2, 2, 2, 1, 3]
    for _ in range(150):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        texts.append(f"{rng.randint(1000, 9999)} {rng.randint(1000, 9999)} {full[:4]} {full[4:8]} {full[8:12]} {full[12:]} {rng.randint(100, 999)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    once = pii.pseudonymise(docs, KEY)
    rows = sorted(once.collect(), key=lambda r: r.doc_id)
    assert [len(r.pii) for r in rows[: len(want)]] == want and all(r.pii for r in rows[14:])
    assert all(card not in r.text and spaced not in r.text and odd not in r.text for r in rows)
    cards = [x.value.replace(" ", "").replace("-", "") for r in rows[:13] for x in r.pii if x.kind == "card"]
    assert all(map(luhn, cards)) and len(set(cards[:4] + cards[5:11])) == 1
    assert rows[0].text.endswith(" 12/27") and rows[1].text.startswith("flat 7 ") and [x.kind for x in rows[10].pii] == ["card", "email"]
    assert [r.text for r in sorted(pii.pseudonymise(once, KEY, back=True).collect(), key=lambda r: r.doc_id)] == texts


def test_equal_phones_stay_linked(spark):
    same = ["+1 017 555 7713", "+10175557713", "+1 (017) 555-7713", "+1017 5557713", "+101 755 57713", "(017) 555-7713"]
    others = ["+49 30 1234567", "+4930 1234567", "+493 01234567", "+352 12 345 678", "+35 212 345 678"]
    docs = spark.createDataFrame(list(enumerate(same + others)), "doc_id int, text string")
    once = pii.pseudonymise(docs, KEY)
    rows = sorted(once.collect(), key=lambda r: r.doc_id)
    assert all(len(r.pii) == 1 for r in rows)
    digits = [re.sub("[^0-9]", "", r.pii[0].value) for r in rows]
    assert len(set(digits[:5])) == 1 and digits[0] == "1" + digits[5] and digits[0][1:] != "0175557713"
    assert len(set(digits[6:9])) == 1 and digits[6].startswith("49") and digits[9] == digits[10] and digits[9].startswith("352")
    assert [r.text for r in sorted(pii.pseudonymise(once, KEY, back=True).collect(), key=lambda r: r.doc_id)] == same + others


class Brute:
    """The permutations spelled out value by value."""

    def __init__(self, key):
        self.key = key

    def sha(self, *parts):
        return hashlib.sha256("|".join([self.key, *map(str, parts)]).encode()).hexdigest()

    def number(self, v, a, b, kind):
        left, right = divmod(v, b)
        for k in range(8):
            left = (left + int(self.sha(kind, "l", k, right)[:15], 16)) % a
            right = (right + int(self.sha(kind, "r", k, left)[:15], 16)) % b
        return left * b + right

    def digits(self, d, kind):
        return str(self.number(int(d), 10 ** (len(d) - len(d) // 2), 10 ** (len(d) // 2), kind)).zfill(len(d))

    def text(self, v, kind):
        def shift(half, sha):
            out = ""
            for i, c in enumerate(half):
                for lo, size in (("0", 10), ("a", 26), ("A", 26)):
                    if ord(lo) <= ord(c) < ord(lo) + size:
                        c = chr(ord(lo) + (ord(c) - ord(lo) + int(sha[i % 16 * 4 :][:4], 16)) % size)
                        break
                out += c
            return out

        left, right = v[: len(v) // 2], v[len(v) // 2 :]
        for k in range(8):
            left = shift(left, self.sha(kind, "l", k, right))
            right = shift(right, self.sha(kind, "r", k, left))
        return left + right


def test_equals_permuting_value_by_value(spark):
    rng, brute, want = random.Random(3), Brute("plain-key"), []
    for i in range(40):
        day = date(1800, 1, 1) + timedelta(days=rng.randrange(189 * 773))
        moved = date(1800, 1, 1) + timedelta(days=brute.number((day - date(1800, 1, 1)).days, 189, 773, "date"))
        want.append((day.isoformat(), moved.isoformat()))
        want.append((day.strftime("%d.%m.%Y"), moved.strftime("%d.%m.%Y")))
        octets = [rng.randrange(256) for _ in range(4)]
        ip = brute.number(int.from_bytes(bytes(octets)), 65536, 65536, "ip").to_bytes(4)
        want.append((".".join(map(str, octets)), ".".join(map(str, ip))))
        area, group, serial = rng.choice([*range(1, 666), *range(667, 900)]), rng.randint(1, 99), rng.randint(1, 9999)
        at = brute.number(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
        index = at // 9999 // 99
        want.append((f"{area:03}-{group:02}-{serial:04}", f"{index + (2 if index > 664 else 1):03}-{at // 9999 % 99 + 1:02}-{at % 9999 + 1:04}"))
        body = "".join(rng.choices("0123456789", k=15))
        check = lambda b: next(c for c in "0123456789" if luhn(b + c))
        moved = brute.digits(body, "card")
        want.append((body + check(body), moved + check(moved)))
        national = f"{rng.randint(200, 999)}{rng.randint(1000000, 9999999)}"
        moved = brute.digits(national, "phone")
        want.append((f"+1 {national[:3]} {national[3:6]} {national[6:]}", f"+1 {moved[:3]} {moved[3:6]} {moved[6:]}"))
        local = "".join(rng.choices("abcXYZ019", k=rng.randint(1, 9)))
        want.append((f"{local}@mail.example.com", f"{brute.text(local, 'email')}@mail.example.com"))
        account = "".join(rng.choices("0123456789", k=18))
        iban = lambda a: f"DE{98 - int(a + '131400') % 97:02}{a}"
        want.append((iban(account), iban(brute.text(account, "iban"))))
    docs = spark.createDataFrame([(i, f"see {a} now") for i, (a, _) in enumerate(want)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs, "plain-key").collect()}
    assert [got[i] for i in range(len(want))] == [f"see {b} now" for _, b in want]
