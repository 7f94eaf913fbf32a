"""Format-preserving pseudonyms of personal numbers and dates, by keyed Feistel permutations.

A value is validated by the rules of its kind and mapped by a permutation of all valid values of its format,
so the pseudonym is valid too, equal values get equal pseudonyms in every document, and the holder of the key
can map them back. Numbers are permuted over Z_a x Z_b: in each round one half is shifted by a keyed hash of
the other, modulo its own size, so no value leaves the domain and no cycle walking is needed. Texts (local
parts of e-mail addresses, account parts of IBANs) are halved likewise and shifted character by character
within digits, capitals and small letters.

Cards are looked for in runs of groups of digits, as other numbers may stand next to them: in each run the
usual forms are tried at every group, then other groupings in what is left. Where the permuted digits would
be cut in another way, they are permuted again until the same cuts are found, so the way back finds them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound

# The formats looked for, in order of preference at one place.
FORMATS = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    r"\+[0-9]{1,3}[ -]?\(?[0-9]{1,4}\)?(?:[ -]?[0-9]{2,4}){2,4}(?![0-9])",
    r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
]
# A run of groups of digits in which cards are looked for; it ends before a value of another format.
RUN = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{'|'.join(FORMATS[:7])})[0-9]++)*+"
PATTERN = "|".join([*FORMATS, RUN])
# Forms of cards, by preference at one place; then other groupings, the first at the start only.
CARDS = [
    r"[0-9]{13,19}", r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", r"[0-9]{4}([ -])[0-9]{6}\1[0-9]{5}",
    r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{3}", r"[0-9]{4}([ -])[0-9]{6}\1[0-9]{4}",
]
START, OTHERS = r"[0-9](?:[ -]?[0-9]){12,18}", [rf"[0-9]{{4,12}}(?:[ -][0-9]{{4,12}}){{{k}}}" for k in (3, 2, 1)]
# Country codes of one and two digits; all others have three.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
DAY_ZERO, DAYS = "DATE'1800-01-01'", (189, 773)  # 189 * 773 days are the 400 years from day zero


class Cipher:
    """SQL text of the permutations under one key; `back` gives their inverses."""

    def __init__(self, key: str, rounds: int = 8, back: bool = False):
        self.key, self.rounds, self.back = key.replace("\\", "\\\\").replace("'", "\\'"), rounds, back

    def hashed(self, kind: str, side: str, k: str, value: str) -> str:
        return f"sha2(concat_ws('|', '{self.key}', '{kind}', '{side}', {k}, {value}), 256)"

    def _add(self, kind: str, side: str, k: str, half: str, other: str, size: str) -> str:
        step = f"cast(conv(substr({self.hashed(kind, side, k, other)}, 1, 15), 16, 10) as bigint)"
        return f"pmod({half} {'-' if self.back else '+'} pmod({step}, {size}), {size})"

    def number(self, value: str, a: str | int, b: str | int, kind: str) -> str:
        """SQL: a long in [0, a * b) permuted within that range; a and b below 2^31."""
        a, b = f"cast({a} as bigint)", f"cast({b} as bigint)"
        if self.back:
            body = bound(self._add(kind, "r", "k", "s.r", "s.l", b), "y", f"named_struct('l', {self._add(kind, 'l', 'k', 's.l', 'y', a)}, 'r', y)")
        else:
            body = bound(self._add(kind, "l", "k", "s.l", "s.r", a), "y", f"named_struct('l', y, 'r', {self._add(kind, 'r', 'k', 's.r', 'y', b)})")
        order = f"sequence({self.rounds - 1}, 0)" if self.back else f"sequence(0, {self.rounds - 1})"
        start = f"named_struct('l', v div {b}, 'r', v % {b})"
        return bound(f"cast({value} as bigint)", "v", bound(f"aggregate({order}, {start}, (s, k) -> {body})", "z", f"z.l * {b} + z.r"))

    def _shift(self, half: str, keyed: str) -> str:
        sign = "-" if self.back else "+"
        step = "cast(conv(substr(h, (i % 16) * 4 + 1, 4), 16, 10) as int)"
        cases = " ".join(f"when c between '{lo}' and '{hi}' then chr({ord(lo)} + pmod(ascii(c) - {ord(lo)} {sign} {step}, {ord(hi) - ord(lo) + 1}))" for lo, hi in ("09", "az", "AZ"))
        return bound(keyed, "h", f"array_join(transform(split({half}, ''), (c, i) -> case {cases} else c end), '')")

    def text(self, value: str, kind: str) -> str:
        """SQL: a string permuted within its format: digits, capitals and small letters keep their places."""
        left, right = self._shift("s.l", self.hashed(kind, "l", "k", "s.r")), self._shift("s.r", self.hashed(kind, "r", "k", "s.l"))
        if self.back:
            body = bound(right, "y", f"named_struct('l', {self._shift('s.l', self.hashed(kind, 'l', 'k', 'y'))}, 'r', y)")
        else:
            body = bound(left, "y", f"named_struct('l', y, 'r', {self._shift('s.r', self.hashed(kind, 'r', 'k', 'y'))})")
        order = f"sequence({self.rounds - 1}, 0)" if self.back else f"sequence(0, {self.rounds - 1})"
        half = "cast(char_length(v) div 2 as int)"
        start = f"named_struct('l', substr(v, 1, {half}), 'r', substr(v, {half} + 1))"
        return bound(value, "v", bound(f"aggregate({order}, {start}, (s, k) -> {body})", "z", "concat(z.l, z.r)"))


def luhn_digit(body: str) -> str:
    """SQL: the check digit that completes a string of digits."""
    digit = "cast(substr(d, -j, 1) as int)"
    total = f"aggregate(sequence(1, char_length(d)), 0, (t, j) -> t + if(j % 2 = 1, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}), {digit}))"
    return bound(body, "d", f"cast((10 - {total} % 10) % 10 as string)")


def mod97(text: str) -> str:
    """SQL: capitals and digits, read as the IBAN rules do, modulo 97."""
    step = "if(c between '0' and '9', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(split({text}, ''), 0, (t, c) -> {step})"


def cards_in(run: str, forms: list[str], start: list[str]) -> str:
    """SQL: array of (at, len) of cards in a string of groups of digits, from left to right.

    At each group the first of `forms` counts that has 13 to 19 digits and passes Luhn, at the first group of
    `start` too. Nesting is kept low, as the analyser goes only so deep.
    """
    tried = [f"regexp_extract(array_join(slice(h, k, 40), ''), r'^(?:{form})(?![0-9])', 0)" for form in forms]
    tried = [f"if(k = 1, regexp_extract(array_join(slice(h, 1, 40), ''), r'^(?:{form})(?![0-9])', 0), '')" for form in start] + tried
    digits = "translate(x, ' -', '')"
    summed = f"aggregate(transform(split(reverse({digits}), ''), (c, j) -> if(j % 2 = 1, 2 * cast(c as int) div 10 + 2 * cast(c as int) % 10, cast(c as bigint))), 0L, (t, c) -> t + c)"
    places = "filter(sequence(1, size(h)), k -> k = 1 or get(h, k - 2) in (' ', '-'))"
    card = f"get(filter(array({', '.join(tried)}), x -> if(char_length({digits}) between 13 and 19, {summed} % 10 = 0, false)), 0)"
    found = f"transform({places}, k -> named_struct('at', k - 1, 'len', char_length({card})))"
    zero = "named_struct('next', 0, 'got', cast(array() as array<struct<at:int,len:int>>))"
    got = f"aggregate({found}, {zero}, (a, e) -> if(e.len is null or e.at < a.next, a, named_struct('next', e.at + e.len, 'got', concat(a.got, array(e))))).got"
    return bound(f"split({run}, '')", "h", got)


def cuts(run: str) -> str:
    """SQL: array of (at, len) of the cards in the run: usual forms first, others in the stretches between them."""
    lo, hi = "if(i = 0, 0, get(u, i - 1).at + get(u, i - 1).len + 1)", f"coalesce(get(u, i).at - 1, char_length({run}))"
    stretches = f"transform(sequence(0, size(u)), i -> named_struct('lo', {lo}, 'part', substr({run}, {lo} + 1, greatest({hi} - {lo}, 0))))"
    others = f"flatten(transform({stretches}, b -> transform({cards_in('b.part', OTHERS, [START])}, q -> named_struct('at', q.at + b.lo, 'len', q.len))))"
    return bound(cards_in(run, CARDS, []), "u", f"array_sort(concat(u, {others}))")


def refill(shape: str, digits: str) -> str:
    """SQL: `shape` with its digits replaced, one by one, by those of `digits`."""
    put = "if(c between '0' and '9', named_struct('out', concat(a.out, substr(n, a.at + 1, 1)), 'at', a.at + 1), named_struct('out', concat(a.out, c), 'at', a.at))"
    return bound(digits, "n", f"aggregate(split({shape}, ''), named_struct('out', '', 'at', 0), (a, c) -> {put}).out")


def pseudonym(cipher: Cipher) -> str:
    """SQL over the match `m`: named_struct of its new text and an array of the (kind, value) that it holds, empty where it isn't valid."""

    def of(kind: str, value: str) -> str:
        return f"named_struct('kind', '{kind}', 'value', {value})"

    no = "named_struct('kind', cast(null as string), 'value', m)"
    email = of("email", f"concat({cipher.text("substring_index(m, '@', 1)", 'email')}, '@', substring_index(m, '@', -1))")
    account = cipher.text("substr(m, 5)", "iban")
    iban = bound(account, "p", f"concat(substr(m, 1, 2), lpad(cast(98 - {mod97("concat(p, substr(m, 1, 2), '00')")} as string), 2, '0'), p)")
    iban = f"if({mod97("concat(substr(m, 5), substr(m, 1, 4))")} = 1, {of('iban', iban)}, {no})"
    dates = []
    for shape, form in (("____-__-__", "yyyy-MM-dd"), ("__/__/____", "MM/dd/yyyy"), ("__.__.____", "dd.MM.yyyy")):
        days = f"datediff(try_to_date(m, '{form}'), {DAY_ZERO})"
        moved = f"date_format(date_add({DAY_ZERO}, cast({cipher.number(days, *DAYS, 'date')} as int)), '{form}')"
        dates.append(f"when m like '{shape}' then if({days} between 0 and {DAYS[0] * DAYS[1] - 1}, {of('date', moved)}, {no})")
    area, group, serial = (f"cast(substr(m, {at}, {n}) as int)" for at, n in ((1, 3), (5, 2), (8, 4)))
    index = f"(if({area} > 666, {area} - 2, {area} - 1) * 99 + {group} - 1) * cast(9999 as bigint) + {serial} - 1"
    area_of = bound("q div 9999 div 99", "g", "lpad(cast(if(g > 664, g + 2, g + 1) as string), 3, '0')")
    ssn = bound(cipher.number(index, 898 * 99, 9999, "ssn"), "q", f"concat({area_of}, '-', lpad(cast(q div 9999 % 99 + 1 as string), 2, '0'), '-', lpad(cast(q % 9999 + 1 as string), 4, '0'))")
    ssn = f"if({area} not in (0, 666) and {area} < 900 and {group} > 0 and {serial} > 0, {of('ssn', ssn)}, {no})"
    octets = "aggregate(split(m, '[.]'), cast(0 as bigint), (t, o) -> t * 256 + cast(o as int))"
    ip = bound(cipher.number(octets, 65536, 65536, "ip"), "q", "concat_ws('.', cast(q div 16777216 as string), cast(q div 65536 % 256 as string), cast(q div 256 % 256 as string), cast(q % 256 as string))")
    ip = f"if(forall(split(m, '[.]'), o -> cast(o as int) < 256), {of('ip', ip)}, {no})"

    def permuted(digits: str, kind: str) -> str:
        """SQL: a string of up to 18 digits permuted among those of its length."""
        n = "char_length(w)"
        a, b = f"pow(10, {n} - {n} div 2)", f"pow(10, {n} div 2)"
        return bound(digits, "w", f"lpad(cast({cipher.number('w', a, b, kind)} as string), cast({n} as int), '0')")

    digits = "regexp_replace(m, '[^0-9]', '')"
    country = f"if(m like '+%', regexp_extract({digits}, '^(?:{COUNTRY})', 0), '')"
    rest = f"substr({digits}, char_length({country}) + 1)"
    phone = f"if(char_length({rest}) between 7 and 14, {of('phone', refill('m', f'concat({country}, {permuted(rest, 'phone')})'))}, {no})"
    part = "substr(l.y, f.at + 1, f.len)"
    numerals = f"regexp_replace({part}, '[^0-9]', '')"
    card = bound(permuted(f"substr({numerals}, 1, char_length({numerals}) - 1)", "card"), "e", refill(part, f"concat(e, {luhn_digit('e')})"))
    moved = f"concat(substr(l.y, 1, f.at), {card}, substr(l.y, f.at + f.len + 1))"
    # A round that leaves the cuts as they are is the last; one in four may not where groups of four adjoin.
    again = bound(moved, "y", f"named_struct('y', y, 'done', {cuts('y')} = cs)")
    walk = f"aggregate(sequence(1, 100), named_struct('y', w, 'done', false), (l, n) -> if(l.done, l, {again})).y"
    order = "reverse(cs)" if cipher.back else "cs"
    run = bound(f"aggregate({order}, m, (w, f) -> {walk})", "out", "named_struct('value', out, 'items', transform(cs, f -> named_struct('kind', 'card', 'value', substr(out, f.at + 1, f.len))))")
    run = bound(cuts("m"), "cs", run)
    other = bound(
        f"case when contains(m, '@') then {email} when m rlike '^[A-Z]' then {iban} {' '.join(dates)} when m like '___-__-____' then {ssn} "
        f"when m rlike '^[0-9]+[.]' then {ip} else {phone} end",
        "x", "named_struct('value', x.value, 'items', filter(array(x), z -> z.kind is not null))",
    )
    return f"if(m rlike '^[0-9]' and char_length({digits}) > 12 and m not like '%.%' and not contains(m, '@'), {run}, {other})"


def pseudonymise(docs: DataFrame, key: str, back: bool = False, found: str = "pii") -> DataFrame:
    """`docs` with personal values in `text` replaced, and the column `pii` (or `found`) of what was replaced.

    It is an array of (kind, value), values being the pseudonyms in order of place; an own column of that
    name in `docs` is replaced. Kinds: email, iban (mod 97), date (of the calendar, 1800 to 2199), ssn (US
    rules), ip (octets below 256), phone (7 to 14 digits after the country code), card (13 to 19 digits,
    Luhn, also next to other numbers). Phones are equal whatever their spacing, as the country code is told from
    the digits; the domains of e-mail addresses stay readable. Equal cards get equal pseudonyms, but for the few that would change the
    cuts of adjoining groups. Matches that fail their rule stay as they are. Null text stays null and, like an empty one, holds
    nothing; rows, repeated ones too, stay one for one with all other columns; an empty table stays empty.
    Texts are searched whole. `back` with the same key restores the original values.
    """
    value = pseudonym(Cipher(key, back=back))
    replaced = f"transform(regexp_extract_all(text, r'{PATTERN}', 0), m -> {value})"
    none = "cast(array() as array<struct<value:string,items:array<struct<kind:string,value:string>>>>)"
    rows = docs.withColumn(found, F.expr(f"if(text rlike '[0-9@]' and text rlike r'{PATTERN}', {replaced}, {none})"))
    gaps = f"split(text, r'{PATTERN}', -1)"
    text = f"if(size({found}) > 0, array_join(transform({gaps}, (g, i) -> concat(g, coalesce(get({found}, i).value, ''))), ''), text)"
    return rows.withColumn("text", F.expr(text)).withColumn(found, F.expr(f"flatten({found}.items)"))
