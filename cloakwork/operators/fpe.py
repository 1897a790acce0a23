"""Format-preserving encryption (FF3 of NIST SP 800-38G) of the letters and digits of identifiers, as column expressions.

Only letters and digits change; all else keeps its place. The blocks of a round go through the engine's own aes_encrypt,
those of an array of texts in one call (ECB: each block for itself), since a call costs far more than a block. Halves of
at most SMALL values are BIGINT; longer ones have at most 96 bits, which DECIMAL(38) holds, and their blocks of 128 bits
are reduced 16 bits at a time. Rounds are a fold, so that a value is named once however often it is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.keyed import Keys

DIGITS = "0123456789"
ALNUM = DIGITS + "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shortest and longest content of each alphabet; shorter ones are padded, longer ones hashed.
LIMITS = {DIGITS: (6, 56), ALNUM: (4, 32)}
ROUNDS = 8
#: Values of half a text that leave room for three bits more in a BIGINT, and for 64 in a DECIMAL(38).
SMALL = 10**18
#: Rows that in_blocks() puts into an array.
BLOCK = 512


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows in arrays of at most BLOCK, dealt out again: a small file, which Spark reads in a task or two, may have many."""
    dealt = rows.select(F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1).alias("block"), F.struct(*rows.columns).alias("row"))
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return dealt.repartition(parts, "block").groupBy("block").agg(F.collect_list("row").alias("rows")).select("rows")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _long(n: int | Column) -> Column:
    return (n if isinstance(n, Column) else F.lit(n)).cast("bigint")


def _whole(n: int | Column) -> Column:
    return (n if isinstance(n, Column) else F.lit(str(n))).cast("decimal(38,0)")


def _quotient(n: Column, by: Column) -> Column:
    return _whole((n - n % by) / by)


def _number(text: Column, alphabet: Column, radix: Column, whole: Callable[[Column | int], Column]) -> Column:
    """The first character counts least."""
    places = F.sequence(F.length(text), F.lit(1), F.lit(-1))
    return F.aggregate(places, whole(0), lambda n, i: whole(n * radix + (F.instr(alphabet, F.substring(text, i, F.lit(1))) - 1)))


def _string(n: Column, size: Column, alphabet: Column, radix: Column, quotient: Callable[[Column, Column], Column]) -> Column:
    def step(a: Column, _: Column) -> Column:
        digit = (a["n"] % radix).cast("int")
        return F.struct(quotient(a["n"], radix).alias("n"), F.concat(a["out"], F.substring(alphabet, digit + 1, F.lit(1))).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), size), F.struct(n.alias("n"), F.lit("").alias("out")), step, lambda a: a["out"])


def _turned(block: Column) -> Column:
    """Bytes in reverse order; as Latin-1 each is a character."""
    return F.encode(F.reverse(F.decode(block, "ISO-8859-1")), "ISO-8859-1")


def _hex(n: Column, size: int) -> Column:
    return F.lpad(F.hex(_long(n)), size, "0")


def _limb(digits: Column, start: int, size: int) -> Column:
    """The number of at most 15 of hexadecimal digits."""
    return _long(F.conv(F.substring(digits, start, size), 16, 10))


def _aes(blocks: Column, n: Column | int, key: bytes) -> Column:
    """n blocks of 16 bytes, given as hexadecimal digits, greatest first, each encrypted for itself; as bytes."""
    sealed = F.aes_encrypt(_turned(F.unhex(blocks)), F.lit(key[::-1]), F.lit("ECB"))
    return _turned(F.substring(sealed, F.lit(1), n * F.lit(16)))


def _shift(m: Column) -> Column:
    """What 2^68 leaves, divided by m; used up to 2^31."""
    return F.when(m <= 2**31, _long(2**60) % m * 256 % m)


def _residue(digits: Column, m: Column, shift: Column) -> Column:
    """What 128 bits leave, divided by m of at most SMALL; shift: _shift(m)."""
    first, digit = _limb(digits, 1, 15) % m, _limb(digits, 16, 1)
    narrow = (first * shift + F.shiftleft(_limb(digits, 16, 15) % m, 8) + _limb(digits, 31, 2)) % m
    wide = (F.shiftleft((F.shiftleft(first, 3) + F.shiftright(digit, 1)) % m, 1) + digit % 2) % m
    low = _whole(F.conv(F.substring(digits, 17, 16), 16, 10))
    return F.when(m <= 2**31, narrow).otherwise(_long((_whole(wide) * _whole(2**64) + low) % _whole(m)))


def _small(items: Column, key: bytes, decrypt: bool) -> Column:
    """ff3_all for texts whose halves have at most SMALL values; null for others."""

    def known(x: Column) -> Column:
        most = F.aggregate(F.sequence(F.lit(1), x["u"]), _long(1), lambda p, _: p * x["radix"])
        number = lambda half: F.when(x["alphabet"] == DIGITS, F.reverse(half).try_cast("bigint")).otherwise(_number(half, x["alphabet"], x["radix"], _long))
        a, b = number(F.substring(x["text"], F.lit(1), x["u"])), number(F.substring(x["text"], x["u"] + 1, x["v"]))
        most_v = lambda y: F.when(y["u"] == y["v"], y["most_u"]).otherwise(F.call_function("div", y["most_u"], y["radix"]))
        shifts = lambda y: y.withField("shift_u", _shift(y["most_u"])).withField("shift_v", _shift(y["most_v"]))
        whole = F.struct(x["alphabet"], x["radix"], x["u"], x["v"], _limb(x["tweak"], 9, 8).alias("tweak_u"), _limb(x["tweak"], 1, 8).alias("tweak_v"), most.alias("most_u"), a.alias("a"), b.alias("b"))
        whole = _let(_let(whole, lambda y: y.withField("most_v", most_v(y))), shifts)
        return F.when(F.pow(x["radix"], x["u"]) <= float(SMALL), whole)

    def of(texts: Column) -> Column:
        def turn(fed: Column, other: Column, i: Column, half: str) -> Column:
            """Round i: what becomes of the other halves."""
            blocks = F.zip_with(texts, fed, lambda x, n: F.coalesce(F.concat(_hex(x[f"tweak_{half}"].bitwiseXOR(i), 8), _hex(n, 24)), F.lit("0" * 32)))

            def new(x: Column, n: Column, d: Column) -> Column:
                m = x[f"most_{half}"]
                y = _residue(d, m, x[f"shift_{half}"])
                return (n - y + m if decrypt else n + y) % m

            def halves(sealed: Column) -> Column:
                return F.transform(texts, lambda x, j: _let(F.hex(F.substring(sealed, j * 16 + 1, F.lit(16))), lambda d: new(x, F.get(other, j), d)))

            return _let(_aes(F.array_join(blocks, ""), F.size(texts), key), halves)

        def step(s: Column, i: Column) -> Column:
            """Rounds i and i + 1, or back."""
            a, b = s["a"], s["b"]
            if decrypt:
                return _let(turn(a, b, i + 1, "v"), lambda c: F.struct(turn(c, a, i, "u").alias("a"), c.alias("b")))
            return _let(turn(b, a, i, "u"), lambda c: F.struct(c.alias("a"), turn(c, b, i + 1, "v").alias("b")))

        def strings(s: Column) -> Column:
            def put(x: Column, n: Column, size: str) -> Column:
                made = _string(n, x[size], x["alphabet"], x["radix"], lambda n, by: F.call_function("div", n, by))
                return F.when(x["alphabet"] == DIGITS, F.reverse(F.lpad(n.cast("string"), x[size], F.lit("0")))).otherwise(made)

            return F.transform(texts, lambda x, j: F.concat(put(x, F.get(s["a"], j), "u"), put(x, F.get(s["b"], j), "v")))

        rounds = [_long(i) for i in range(0, ROUNDS, 2)]
        start = F.struct(F.transform(texts, lambda x: x["a"]).alias("a"), F.transform(texts, lambda x: x["b"]).alias("b"))
        return F.aggregate(F.array(*(rounds[::-1] if decrypt else rounds)), start, step, strings)

    u = lambda x: F.ceil(F.length(x["text"]) / 2).cast("int")
    sized = F.transform(items, lambda x: F.struct(x["text"], x["tweak"], x["alphabet"], _long(F.length(x["alphabet"])).alias("radix"), u(x).alias("u"), (F.length(x["text"]) - u(x)).alias("v")))
    return _let(F.transform(sized, known), of)


def _large(text: Column, key: bytes, tweak: Column, alphabet: Column, decrypt: bool) -> Column:
    """ff3 of any text."""
    limb = _whole(2**48)

    def block(n: Column, tweak_half: Column, i: Column) -> Column:
        """The round's block as 32 hexadecimal digits, greatest first."""
        w = F.conv(tweak_half, 16, 10).cast("bigint").bitwiseXOR(i.cast("bigint"))
        return F.hex(_aes(F.concat(_hex(w, 8), _hex(_quotient(n, limb), 12), _hex(n % limb, 12)), 1, key))

    def residue(digits: Column, m: Column) -> Column:
        """What 128 bits leave, divided by m."""
        parts = F.transform(F.regexp_extract_all(digits, F.lit("(.{4})"), F.lit(1)), lambda d: _whole(F.conv(d, 16, 10)))
        return F.aggregate(parts, _whole(0), lambda r, d: _whole((r * _whole(65536) + d) % m))

    def of(x: Column) -> Column:
        """x: the text t, its tweak w, the lengths u and v of its halves, and how many values each can have."""
        t, letters, radix = x["t"], x["letters"], x["radix"]

        def step(a: Column, i: Column) -> Column:
            odd = i % 2 == 1
            m = F.when(odd, x["most_v"]).otherwise(x["most_u"])
            half = F.when(odd, F.substring(x["w"], 1, 8)).otherwise(F.substring(x["w"], 9, 8))
            fed, other = (a["a"], a["b"]) if decrypt else (a["b"], a["a"])
            y = residue(block(fed, half, i), m)
            new = _whole((other - y + m) % m) if decrypt else _whole((other + y) % m)
            return F.struct(new.alias("a"), fed.alias("b")) if decrypt else F.struct(fed.alias("a"), new.alias("b"))

        halves = F.struct(_number(F.substring(t, F.lit(1), x["u"]), letters, radix, _whole).alias("a"), _number(F.substring(t, x["u"] + 1, x["v"]), letters, radix, _whole).alias("b"))
        order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if decrypt else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(order, halves, step, lambda a: F.concat(_string(a["a"], x["u"], letters, radix, _quotient), _string(a["b"], x["v"], letters, radix, _quotient)))

    u = F.ceil(F.length(text) / 2).cast("int")
    v, radix = F.length(text) - u, _whole(F.length(alphabet))
    most = lambda n: F.aggregate(F.sequence(F.lit(1), n), _whole(1), lambda p, _: _whole(p * radix))
    known = F.struct(text.alias("t"), tweak.alias("w"), alphabet.alias("letters"), radix.alias("radix"), u.alias("u"), v.alias("v"), most(u).alias("most_u"), most(v).alias("most_v"))
    return _let(known, of)


def ff3_all(items: Column, key: bytes, decrypt: bool = False) -> Column:
    """ff3 of an array of struct(text, tweak, alphabet)."""

    def either(small: Column) -> Column:
        full = lambda x: x["text"].isNotNull() & x["tweak"].isNotNull() & x["alphabet"].isNotNull()
        return F.transform(items, lambda x, j: F.when(full(x), F.coalesce(F.get(small, j), _large(x["text"], key, x["tweak"], x["alphabet"], decrypt))))

    return _let(_small(items, key, decrypt), either)


def item(text: Column, tweak: Column, alphabet: Column) -> Column:
    return F.struct(text.alias("text"), tweak.alias("tweak"), alphabet.alias("alphabet"))


def ff3(text: Column, key: bytes, tweak: Column, alphabet: Column, decrypt: bool = False) -> Column:
    """text, of an alphabet's characters only, encrypted or decrypted under a key and a tweak of 16 hexadecimal digits.

    Null where text, tweak or alphabet is null; half of a text must have a value below 10^32 (56 digits, 32 letters or
    digits), so that 16 bits more fit DECIMAL(38).
    """
    return F.element_at(_let(F.array(item(text, tweak, alphabet)), lambda x: ff3_all(x, key, decrypt)), 1)


def _filled(text: Column, content: Column) -> Column:
    """text with its letters and digits replaced by those of content; what is left of content follows."""

    def of(pieces: Column) -> Column:
        return F.array_join(F.zip_with(pieces, F.split(F.substring(content, F.lit(1), F.size(pieces) - 1), ""), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")

    return _let(F.split(text, "[0-9A-Za-z]", -1), lambda pieces: F.concat(of(pieces), F.substring(content, F.size(pieces), F.length(content))))


def _identifiers(texts: Column, keys: Keys, decrypt: bool) -> Column:
    key = hashlib.sha256(keys.both).digest()[:16]

    def sized(content: Column) -> Column:
        """What is known of a text's letters and digits."""
        either = lambda digits, a, b: F.when(digits, F.lit(a)).otherwise(F.lit(b))
        named = lambda c, n, digits: F.struct(c.alias("content"), n.alias("n"), either(digits, DIGITS, ALNUM).alias("alphabet"), *(either(digits, a, b).alias(k) for k, a, b in zip(("least", "most"), LIMITS[DIGITS], LIMITS[ALNUM])))
        return named(content, F.length(content), ~content.rlike("[A-Za-z]"))

    def padded(x: Column) -> Column:
        kind = F.when(F.length(x["alphabet"]) == 10, "numeric:").otherwise("alphanumeric:")
        tweak = F.substring(F.sha2(F.concat(kind, x["n"].cast("string"), F.lit(f":{key.hex()}")), 256), 1, 16)
        return item(F.when((x["n"] > 0) & (x["n"] <= x["most"]), F.rpad(x["content"], F.greatest(x["n"], x["least"]), F.lit("0"))), tweak, x["alphabet"])

    def new(x: Column, sealed: Column) -> Column:
        return F.when(x["n"] > x["most"], F.sha2(F.concat(x["content"], F.lit(key.hex())), 256)).otherwise(F.substring(sealed, F.lit(1), x["n"]))

    def of(known: Column) -> Column:
        sealed = _let(F.transform(known, padded), lambda items: ff3_all(items, key, decrypt))
        return _let(sealed, lambda out: F.transform(texts, lambda t, j: F.when(F.get(known, j)["n"] == 0, t).otherwise(_let(new(F.get(known, j), F.get(out, j)), lambda c: _filled(t, c)))))

    return _let(F.transform(F.transform(texts, lambda t: F.regexp_replace(t, "[^0-9A-Za-z]", "")), sized), of)


def encrypt_all(texts: Column, keys: Keys) -> Column:
    """encrypt of an array of texts."""
    return _identifiers(texts, keys, False)


def decrypt_all(texts: Column, keys: Keys) -> Column:
    return _identifiers(texts, keys, True)


def encrypt(text: Column, keys: Keys) -> Column:
    """text in its format, under keys. Null and texts without letters or digits stay; content that is too short is
    padded, encrypted and cut (and so not reversible), content that is too long is replaced by a keyed hash."""
    return F.element_at(_let(F.array(text), lambda t: encrypt_all(t, keys)), 1)


def decrypt(text: Column, keys: Keys) -> Column:
    return F.element_at(_let(F.array(text), lambda t: decrypt_all(t, keys)), 1)
