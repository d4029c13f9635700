"""Format-preserving pseudonyms for personal data (operator 6). DataFrame functions only.

Values are found by one regular expression and validated: card numbers by issuer, length and Luhn sum, IBANs by their check digits, addresses of the Internet by their
ranges, dates by the calendar, telephone and social security numbers by their numbering plans. Each is permuted by a keyed Feistel network over the characters that may vary, each within its own
alphabet (digits, small and capital letters, hexadecimal digits), so a pseudonym has the value's length, marks and
layout, equal values have equal pseudonyms in all documents, and no two values share one. Cards keep their issuer's digits and
end in the digit that makes the Luhn sum right; dates move within 1900 to 2099 by a Feistel network over day numbers. Narrow: texts never leave their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
KEYS = "(?i:password|passwd|pwd|secret|api_key|apikey|token)"
HEX = "(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})"
#: What stands alone as a hexadecimal or access key is one too where it is assigned, so that it has one pseudonym.
OWN = rf"(?![\"']?(?:{HEX}|(?:AKIA|ASIA)[A-Z0-9]{{16}})(?:[\"'\s,;)]|$))"
#: One alternative for each kind, the first that matches at a place counts. No group catches anything: split() and extraction agree.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    # quoted; or after =; or after : where a digit tells it from prose
    "password": rf"(?<![A-Za-z0-9]){KEYS}[\"']?[ \t]*+(?:[=:][ \t]*+{OWN}(?:\"[^\"\r\n]{{6,}}\"|'[^'\r\n]{{6,}}')|(?:=[ \t]*+|:[ \t]*+(?=[^\s\"'<>&]*[0-9])){OWN}[^\s\"'<>&]{{6,}})",
    "hex": rf"(?<![A-Za-z0-9]){HEX}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\p{L}\p{N}./-])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)[0-9]{2}|(?:0[1-9]|1[0-2])/(?:1[3-9]|2[0-9]|3[01])/(?:19|20)[0-9]{2})(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "card": r"(?<![\p{L}\p{N}.-])[2-6](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}]|-[0-9])",
    "ssn": r"(?<![\p{L}\p{N}.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "phone": r"(?<![\p{L}\p{N}.+-])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![\p{L}\p{N}]|[.-][0-9])|(?<![\p{L}\p{N}.])\+[0-9]{8,15}(?![\p{L}\p{N}])",
}
FINDER = "|".join(KINDS.values())
#: Any text with a value has one of these; others are passed on as they are.
CUE = rf"[0-9]|@|{KEYS}[\"']?[ \t]*[=:]"
#: The digits that card numbers of each issuer begin with, and their lengths.
ISSUERS = "^(4([0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(0[0-5]|[68][0-9])[0-9]{11}|35(2[89]|[3-8][0-9])[0-9]{12}|6(011|5[0-9]{2}|4[4-9][0-9])[0-9]{12,15}|(5018|5020|5038|6304|6759|676[1-3])[0-9]{8,15}|62[0-9]{14,17})$"
#: Areas, groups and serials that no social security number has; North American numbers, and others with a trunk 0.
NO_SSN = "^(000|666|9)|-00-|-0000$"
NATIONAL = "^[(]?[2-9][0-9]{2}[)]?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$|^[(]?0"
FIRST_DAY, DAYS, LEFT, RIGHT = "1900-01-01", 73_049, 17, 4_297  # LEFT * RIGHT days from 1900 to 2099


SPACELESS = "regexp_replace(ic, ' ', '')"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def let(name: str, value: str, body: str) -> str:
    """SQL: body with name standing for value, which is computed once: Catalyst copies a column into every place that names it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def literal(pattern: str) -> str:
    """SQL: a regular expression as a string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(x: str, sizes: str, key: str) -> str:
    """SQL: array x of numbers below `sizes`, moved one to one.

    Each round adds to one half of x numbers drawn from a hash of the key, the round and the other half, each modulo
    its size. Subtracting undoes a round.
    """
    other = "if(r % 2 = 0, slice(s, hf + 1, size(s) - hf), slice(s, 1, hf))"
    text = f"concat_ws(',', {key}, r, size(s), array_join(transform({other}, q -> cast(q as string)), '.'))"
    stream = let("tx", text, "concat(sha2(tx, 512), sha2(concat(tx, '+'), 512))")
    add = "(v + cast(conv(substring(h, (i % 32) * 8 + 1, 7), 16, 10) as int)) % element_at(sz, i + 1)"
    turn = let("h", stream, f"transform(s, (v, i) -> if((i < hf) = (r % 2 = 0), {add}, v))")
    return let("sz", sizes, let("hf", "cast(size(sz) div 2 as int)", f"aggregate(sequence(0, {ROUNDS - 1}), {x}, (s, r) -> {turn})"))


def luhn(digits: str) -> str:
    """SQL: the Luhn sum, modulo 10, of a digit string that ends in its check digit."""
    one = let("d", f"cast(substring({digits}, k, 1) as int) * if((length({digits}) - k) % 2 = 1, 2, 1)", "if(d > 9, d - 9, d)")
    return f"(aggregate(sequence(1, length({digits})), 0, (t, k) -> t + {one}) % 10)"


def mod97(iban: str) -> str:
    """SQL: an IBAN without spaces, its first four characters moved to the end, as a number modulo 97."""
    line = f"concat(substring({iban}, 5), substring({iban}, 1, 4))"
    return let("ib", line, "aggregate(sequence(1, length(ib)), 0, (t, k) -> if(substring(ib, k, 1) rlike '[0-9]', (t * 10 + cast(substring(ib, k, 1) as int)) % 97, (t * 100 + ascii(substring(ib, k, 1)) - 55) % 97))")


def moved(body: str, key: str, kind: str) -> str:
    """SQL: body with its letters and digits permuted, each within its alphabet, and its marks where they were."""
    bare = let("bd", body, "BARE")
    # a hexadecimal value in both cases keeps the case of each letter
    both = "case when c between '0' and '9' then '0123456789' when c between 'a' and 'f' then 'abcdef' else 'ABCDEF' end"
    hexadecimal = f"case when not ba rlike '[A-F]' then '0123456789abcdef' when not ba rlike '[a-f]' then '0123456789ABCDEF' else {both} end"
    alphabet = {"hex": hexadecimal, "secret": f"'{LETTERS.upper()}0123456789'"}.get(kind, f"case when c between '0' and '9' then '0123456789' when c between 'a' and 'z' then '{LETTERS}' else '{LETTERS.upper()}' end")
    chars = "transform(sequence(1, length(ba)), j -> substring(ba, j, 1))"
    perm = let("ch", chars, let("al", f"transform(ch, c -> {alphabet})", let("mv", feistel("zip_with(al, ch, (a1, c1) -> instr(a1, c1) - 1)", "transform(al, a1 -> length(a1))", key), "array_join(zip_with(mv, al, (v1, a1) -> substring(a1, v1 + 1, 1)), '')")))
    back = "array_join(transform(sequence(1, length(bd)), j -> if(substring(bd, j, 1) rlike '[A-Za-z0-9]', substring(pm, length(regexp_replace(substring(bd, 1, j), '[^A-Za-z0-9]', '')), 1), substring(bd, j, 1))), '')"
    return bare.replace("BARE", let("ba", "regexp_replace(bd, '[^A-Za-z0-9]', '')", f"if(ba = '', bd, {let('pm', perm, back)})"))


def pseudonym(v: str, secret: str) -> str:
    """SQL: the pseudonym of a value that the finder found; the value itself where it isn't valid."""
    key = lambda kind: "'" + f"{secret}:{kind}".replace("'", "''") + "'"
    between = lambda kind, first, last, v=v: f"concat(substring({v}, 1, {first} - 1), {moved(f'substring({v}, {first}, {last} - {first} + 1)', key(kind), kind)}, substring({v}, {last} + 1))"
    issuer = "if(cw like '4%', 2, length(regexp_extract(cw, '^([0-9][ -]?){4}', 0)) + 1)"
    card = let("cv", between("card", issuer, "(length(cw) - 1)", "cw"), let("cd", "regexp_replace(cv, '[^0-9]', '')", let("body", "concat(substring(cd, 1, length(cd) - 1), '0')", f"concat(substring(cv, 1, length(cv) - 1), cast((10 - {luhn('body')}) % 10 as string))")))
    # a number may stand before or after a card: the card is the longest run of whole groups whose Luhn sum is right
    begins_at = f"filter(sequence(1, length({v})), p1 -> p1 <= length({v}) - 12 and substring({v}, p1, 1) between '2' and '6' and (p1 = 1 or substring({v}, p1 - 1, 1) in (' ', '-')))"
    digits = f"regexp_replace(substring({v}, p1, p2 - p1 + 1), '[^0-9]', '')"
    valid = let("dg", digits, f"dg rlike {literal(ISSUERS)} and {luhn('dg')} = 0")
    ends_at = f"filter(sequence(p1 + 12, length({v})), p2 -> (p2 = length({v}) or substring({v}, p2 + 1, 1) in (' ', '-')) and substring({v}, p2, 1) between '0' and '9' and {valid})"
    span = f"array_max(flatten(transform({begins_at}, p1 -> transform({ends_at}, p2 -> struct(p2 - p1 as n, -p1 as b, p1 as f, p2 as t)))))"
    card = let("sp", span, f"if(sp is null, {v}, concat(substring({v}, 1, sp.f - 1), {let('cw', f'substring({v}, sp.f, sp.n + 1)', card)}, substring({v}, sp.t + 1)))")
    assigned = f"length(regexp_extract({v}, {literal(ASSIGNED)}, 0)) + 1"
    iban = let("iv", between("iban", "5", f"length({v})"), let("ic", "concat(substring(iv, 1, 2), '00', substring(iv, 5))", f"concat(substring(iv, 1, 2), lpad(cast(98 - {mod97(SPACELESS)} as string), 2, '0'), substring(iv, 5))"))
    octets = let("oc", f"transform(split({v}, '[.]'), o -> cast(o as int))", let("fe", feistel("array(oc[0] * 256 + oc[1], oc[2] * 256 + oc[3])", "array(65536, 65536)", key("ip")), "concat_ws('.', fe[0] div 256, fe[0] % 256, fe[1] div 256, fe[1] % 256)"))

    def date(style: str, after: int = 0) -> str:
        """after: the pseudonym's day is one after it, as the value's is; the permutation goes on until that is so."""
        day = f"try_to_date({v}, '{style}')"
        move = lambda n: let("fd", feistel(f"array(cast({n} div {RIGHT} as int), cast({n} % {RIGHT} as int))", f"array({LEFT}, {RIGHT})", key("date")), f"fd[0] * {RIGHT} + fd[1]")
        number = move("dn")
        if after:
            number = f"aggregate(sequence(1, 64), {number}, (t, k) -> if(day(date_add(date'{FIRST_DAY}', cast(t as int))) > {after}, t, {move('t')}))"
        new = let("dn", f"datediff({day}, date'{FIRST_DAY}')", f"date_format(date_add(date'{FIRST_DAY}', cast({number} as int)), '{style}')")
        return f"if({day} is null, {v}, {new})"

    numbers = f"length(regexp_replace({v}, '[^0-9]', ''))"
    phone = f"{numbers} between 8 and 15 and ({v} like '+%' or {v} rlike {literal(NATIONAL)} and {numbers} between 9 and 12)"
    begins = f"length(regexp_extract({v}, '^[+]([0-9]{{1,3}}[ .-]|[0-9]{{2}})', 0)) + 1"
    whole = {k: f"{v} rlike {literal(f'^(?:{p})$')}" for k, p in PLAIN.items()}
    return f"""case
        when {v} is null then ''
        when {whole['password']} then {between('password', f'({assigned})', f'length({v})')}
        when {whole['email']} then {between('email', '1', f"(instr({v}, '@') - 1)")}
        when {whole['secret']} then {between('secret', '5', f'length({v})')}
        when {whole['hex']} then {between('hex', '1', f'length({v})')}
        when {whole['date']} then case when {v} like '____-%' then {date('yyyy-MM-dd')} when {v} rlike '^../(1[3-9]|[23])' then {date('MM/dd/yyyy', 12)} when {v} like '%/%' then {date('dd/MM/yyyy')} else {date('dd.MM.yyyy')} end
        when {whole['ip']} then if(forall(split({v}, '[.]'), o -> cast(o as int) <= 255), {octets}, {v})
        when {whole['card']} then {card}
        when {whole['iban']} then if({let('iw', f"regexp_replace({v}, ' ', '')", mod97('iw'))} = 1, {iban}, {v})
        when {whole['ssn']} then if({v} rlike {literal(NO_SSN)}, {v}, {between('ssn', '1', f'length({v})')})
        else if({phone}, {between('phone', f'({begins})', f'length({v})')}, {v}) end"""


#: What stands before an assigned value.
ASSIGNED = "^[A-Za-z_]+[\"']?[ \\t]*[=:][ \\t]*"
#: What a value of each kind looks like when it stands alone.
PLAIN = {
    "email": "[^@]+@[^@]+",
    "secret": "(AKIA|ASIA)[A-Z0-9]{16}",
    "password": f"{KEYS}[\"']?[ \\t]*[=:].*",
    "hex": HEX,
    "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}",
    "ip": "([0-9]{1,3}[.]){3}[0-9]{1,3}",
    "card": "[2-6]([ -]?[0-9]){12,18}",
    "iban": "[A-Z]{2}[0-9]{2}[ A-Z0-9]+",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def pieces(text: str, secret: str) -> tuple[Column, Column]:
    """The values found in the text column, in order, and what takes their places; empty arrays where there are none."""
    found, cue = literal(FINDER), literal(CUE)
    values = F.expr(f"case when `{text}` rlike {cue} then regexp_extract_all(`{text}`, {found}, 0) else cast(array() as array<string>) end")
    return values, F.expr(f"transform(__found, v -> {pseudonym('v', secret)})")


def with_pieces(docs: DataFrame, text_col: str, secret: str) -> DataFrame:
    """docs with __found and __new; their text goes together again in joined()."""
    values, new = pieces(text_col, secret)
    return docs.withColumn("__found", values).withColumn("__new", new)


def joined(text: str) -> Column:
    return F.expr(f"if(coalesce(size(__found), 0) > 0, array_join(zip_with(split(`{text}`, {literal(FINDER)}, -1), __new, (p, v) -> concat(p, coalesce(v, ''))), ''), `{text}`)")


def pseudonymise(docs: DataFrame, *, secret: str, text_col: str = "text") -> DataFrame:
    """docs with text_col replaced and all other columns as they were, whatever their names (but __found and __new).

    Null and empty texts stay. Repeated rows stay. A text without values comes back unchanged. Invalid values stay.
    secret: the key of the permutations; whoever has it can undo them. It stands in the query's plan, so keep event logs as safe as the key, or set
    spark.sql.redaction.string.regex.
    """
    return with_pieces(docs, text_col, secret).withColumn(text_col, joined(text_col)).select(*docs.columns)


def pseudonym_report(docs: DataFrame, *, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, n_values, n_replaced, text), one row per input row: the values found, those that were valid and so replaced, each at its place, the new text."""
    rows = with_pieces(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", secret)
    n = F.expr("coalesce(size(filter(zip_with(__found, __new, (v, w) -> v <> w), x -> x)), 0)")
    return rows.select(F.col("__id").alias(id_col), F.expr("coalesce(size(__found), 0)").cast("long").alias("n_values"), n.cast("long").alias("n_replaced"), joined("__text").alias("text"))
