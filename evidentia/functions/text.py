"""Text columns: three tokenizers, two sentence splitters, quotation classes, runs, cues, support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vietnamese function words, image cues.
STOP_WORDS = """
và hoặc là của cho với trong trên dưới ngoài từ đến về theo tại bởi bằng như
vào ra lên xuống qua sang cùng giữa sau trước khi mà thì nên nếu vì do bởi_vì
các những mọi mỗi một hai này đó ấy kia đây nào gì ai sao vậy thế
được bị có không chưa đã đang sẽ vẫn còn cũng rất quá lắm hơn nhất
để phải cần nên việc sự cái con chiếc người
tôi ta chúng họ nó mình bạn anh chị em
ở nữa chỉ thêm cả tất_cả đều song tuy nhưng vả lại thậm chí
hay khác trở nhằm chẳng hạn ví dụ tức
""".split()
CUES = ["dựa vào hình", "dựa vào ảnh", "theo hình", "xem sơ đồ", "trong hình", "hình ảnh"]
UNSAFE = ["/home/", "/users/", "file://", "bearer ", "api_key", "api-key", "sk-"]


def _icu(name: str, method: str, x: Column, flag: bool) -> Column:
    """A static method of the Unicode library that the engine has for collations, inside the JVM; null stays null."""
    return F.when(x.isNotNull(), F.reflect(F.lit(f"com.ibm.icu.{name}"), F.lit(method), F.coalesce(x, F.lit("")), F.lit(flag)))


def nfc(x: Column) -> Column:
    return _icu("text.Normalizer", "compose", x, False)


def strip_marks(x: Column) -> Column:
    """NFD without combining marks (those of a combining class; of the three kinds of marks, all that letters here can have)."""
    return F.regexp_replace(_icu("text.Normalizer", "decompose", x, False), r"\p{Mn}+", "")


def casefold(x: Column) -> Column:
    return _icu("lang.UCharacter", "foldCase", x, True)


def strip(x: Column) -> Column:
    """Without white space of any kind, separators 1C to 1F included, at both ends; F.trim knows the space alone."""
    return F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits of the NFC form, without underscore."""
    return F.regexp_extract_all(F.lower(nfc(x)), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def legal_words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(nfc(x)), F.lit("[a-zA-ZÀ-ỹ0-9]+"), F.lit(0))


def word_run(x: Column) -> Column:
    """Case-folded \\w+ runs, underscore kept."""
    return F.regexp_extract_all(casefold(x), F.lit(r"(?U)\w+"), F.lit(0))


def contains_run(answer: Column, text: Column) -> Column:
    """Whether the answer's words stand in the text side by side; false for an answer without words."""
    a, t = word_run(answer), word_run(text)
    return (F.size(a) > 0) & F.contains(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" ")))


def content_tokens(x: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    return F.filter(tokens(x), lambda t: ~F.array_contains(stop, t))


def sentences(x: Column, least: int = 25) -> Column:
    return F.filter(F.transform(F.split(x, r"(?<=[.;:!?])\s+|\n+"), strip), lambda s: F.char_length(s) >= least)


def split_sentences(x: Column) -> Column:
    return F.filter(F.split(x, r"(?<=[.!?;:])\s+|\n+"), lambda s: strip(s) != "")


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(nfc(x), r"(?U)\s+", " "))


def quote_class(quote: Column, source: Column) -> Column:
    """missing, exact, normalised, elided (two or more fragments of eight characters or more, in order) or non_verbatim."""
    q, s = collapsed(quote), collapsed(source)
    parts = F.filter(F.transform(F.split(q, r"\.\.\.|…"), lambda p: F.trim(p)), lambda p: p != "")
    at = F.aggregate(parts, F.lit(1), lambda pos, p: F.when(pos == 0, 0).otherwise(F.call_function("locate", p, s, pos)) + F.when((pos > 0) & (F.call_function("locate", p, s, pos) > 0), F.char_length(p)).otherwise(0))
    elided = (F.size(parts) >= 2) & F.forall(parts, lambda p: F.char_length(p) >= 8) & (at > 0)
    return F.when(quote.isNull() | (q == ""), "missing").when(F.contains(source, quote), "exact").when(F.contains(s, q), "normalised").when(elided, "elided").otherwise("non_verbatim")


def longest_common_run(a: Column, b: Column, most: int | None = 30) -> Column:
    """Longest run of consecutive words of a that stands in b; `most` at most, if given.

    Hashes of runs of 1, 2, 4, ... words, each from two of half its length, as far as the two sides share one;
    then the longest shared run is put together from the longest of them downwards. Linear in the words for
    each of these steps, whose number is the logarithm of the run.
    """
    join = lambda x, y, by, n: F.transform(F.slice(x, F.lit(1), n), lambda v, i: F.xxhash64(v, F.get(y, i + by)))
    one = lambda x: F.transform(x, lambda w: F.xxhash64(w))
    last = lambda x: F.element_at(x, -1)
    two = lambda n: F.call_function("shiftleft", F.lit(1), n)

    def up(acc: Column, j: Column) -> Column:
        width = two(j - 1)
        room = (F.size(acc["a"]) == j) & (F.size(last(acc["a"])) > width) & (F.size(last(acc["b"])) > width)

        def longer(x: Column) -> Column:
            return F.struct(F.array_append(acc["a"], x.a).alias("a"), F.array_append(acc["b"], x.b).alias("b"))

        twice = lambda x: join(last(x), last(x), width, F.size(last(x)) - width)
        new = F.filter(F.transform(F.filter(F.array(F.lit(1)), lambda _: room), lambda _: F.struct(twice(acc["a"]).alias("a"), twice(acc["b"]).alias("b"))), lambda x: F.arrays_overlap(x.a, x.b))
        return F.coalesce(F.get(F.transform(new, longer), F.lit(0)), acc)

    def down(levels: Column):
        def step(acc: Column, m: Column) -> Column:
            width = two(m)
            room = (F.size(acc["a"]) > width) & (F.size(acc["b"]) > width)
            more = lambda x, y: join(x, F.get(y, m), acc["n"], F.size(x) - width)
            new = F.transform(F.filter(F.array(F.lit(1)), lambda _: room), lambda _: F.struct((acc["n"] + width).alias("n"), more(acc["a"], levels["a"]).alias("a"), more(acc["b"], levels["b"]).alias("b")))
            return F.coalesce(F.get(F.filter(new, lambda x: F.arrays_overlap(x.a, x.b)), F.lit(0)), acc)

        k = F.size(levels["a"])
        zero = F.struct(two(k - 1).alias("n"), last(levels["a"]).alias("a"), last(levels["b"]).alias("b"))
        return F.aggregate(F.when(k > 1, F.sequence(k - 2, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>")), zero, step, lambda acc: acc["n"])

    steps = F.when(F.size(a) > 1, F.sequence(F.lit(1), F.ceil(F.log2(F.size(a))).cast("int"))).otherwise(F.array().cast("array<int>"))
    first = F.filter(F.array(F.struct(one(a).alias("a"), one(b).alias("b"))), lambda x: F.arrays_overlap(x.a, x.b))
    levels = F.transform(first, lambda x: F.aggregate(steps, F.struct(F.array(x.a).alias("a"), F.array(x.b).alias("b")), up))
    found = F.coalesce(F.get(F.transform(levels, down), F.lit(0)), F.lit(0))
    return found if most is None else F.least(found, F.lit(most))


def cues(stem: Column, phrases: list[str] = CUES) -> Column:
    """The phrases that stand, as substrings, in the token-joined text."""
    joined = F.array_join(tokens(stem), " ")
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(joined, p))


def unsafe(x: Column) -> Column:
    low = F.lower(x)
    hit = F.exists(F.array(*[F.lit(m) for m in UNSAFE]), lambda m: F.contains(low, m))
    return hit | low.rlike(r"[a-z]:\\")


def python_round(x: Column, digits: int) -> Column:
    """A double rounded by its exact binary value, ties to even: only doubles that are exact ties differ from round()."""
    scaled = x * 10.0**digits
    tie = (F.abs(scaled - F.floor(scaled) - 0.5) == 0.0) & (scaled / 10.0**digits == x) & (x * 2**20 == F.floor(x * 2**20))
    return F.when(tie, F.bround(x, digits)).otherwise(F.round(x, digits))
