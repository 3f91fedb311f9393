"""Column functions over letter sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twenty residue letters by one-letter order, and in the order of their three-letter codes.
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
THREE_LETTER_ORDER = "ARNDCQEGHILKMFPSTWYV"
#: Eight to three structure classes, as the common table has them and as the alignment scorer does.
SS8_COMMON = ("GIBTS", "HHELL")
SS8_SCORER = ("GIBTS", "LLLLL")


def letters(seq: Column) -> Column:
    """Array of single letters; empty for the empty sequence."""
    return F.filter(F.split(seq, ""), lambda c: F.length(c) > 0)


def one_hot(seq: Column, alphabet: str = LETTERS) -> Column:
    """Each letter as a 0/1 vector over the alphabet; unknown letters are all zero."""
    names = F.array(*[F.lit(a) for a in alphabet])
    return F.transform(letters(seq), lambda c: F.transform(names, lambda a: (a == c).cast("int")))


def ordinal(seq: Column, alphabet: str = LETTERS, gap: int = 20, other: int = 20) -> Column:
    """Each letter's place in the alphabet from 0; gaps and letters outside have codes of their own."""
    names = F.array(*[F.lit(a) for a in alphabet])
    place = lambda c: F.array_position(names, c).cast("int") - 1
    return F.transform(letters(seq), lambda c: F.when(c.isin("-", "."), gap).when(F.array_contains(names, c), place(c)).otherwise(other))


def decode(codes: Column, alphabet: str) -> Column:
    return F.array_join(F.transform(codes, lambda k: F.substring(F.lit(alphabet), k + 1, F.lit(1))), "")


def ungapped_length(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "-", ""))


def drop_insertions(seq: Column) -> Column:
    """Aligned columns alone: lower-case insertions go."""
    return F.regexp_replace(seq, "[a-z]", "")


def clean(seq: Column, alphabet: str = LETTERS) -> Column:
    """Letters outside the alphabet become X; gaps stay."""
    return F.regexp_replace(seq, f"[^{alphabet}-]", "X")


def mask_end_gaps(seq: Column, mark: str = ".") -> Column:
    """Gaps before the first and after the last letter become ``mark``."""
    core = F.regexp_replace(F.regexp_replace(seq, "^-+", ""), "-+$", "")
    head = F.length(seq) - F.length(F.regexp_replace(seq, "^-+", ""))
    tail = F.length(seq) - F.length(core) - head
    blank = F.length(core) == 0
    return F.when(blank, F.repeat(F.lit(mark), F.length(seq))).otherwise(F.concat(F.repeat(F.lit(mark), head), core, F.repeat(F.lit(mark), tail)))


def plain(seq: Column) -> Column:
    """Upper case without gap characters."""
    return F.upper(F.translate(seq, ".-", ""))


def pad(seq: Column, head: Column, total: Column) -> Column:
    """Gaps before (``head``) and after, up to the total length."""
    return F.concat(F.repeat(F.lit("-"), head), seq, F.repeat(F.lit("-"), total - head - F.length(seq)))


def with_linkers(parts: Column, linker: str) -> Column:
    return F.array_join(parts, linker)


def terminal_tag(seq: Column, letter: str = "H", least: int = 3, within: int = 20) -> Column:
    """1 for every letter of a run of ``least`` or more tag letters that starts or ends near a terminus."""
    run = f"{letter}{{{least},}}"
    head = F.regexp_extract(F.substring(seq, 1, within), f"^([^{letter}]*(?:{letter}{{1,{least - 1}}}[^{letter}]+)*)({run})", 1)
    hit = F.regexp_extract(F.substring(seq, 1, within), run, 0)
    back = F.reverse(seq)
    tail = F.regexp_extract(F.substring(back, 1, within), f"^([^{letter}]*(?:{letter}{{1,{least - 1}}}[^{letter}]+)*)({run})", 1)
    tail_hit = F.regexp_extract(F.substring(back, 1, within), run, 0)
    n = F.length(seq)
    in_head = lambda p: (F.length(hit) > 0) & (p > F.length(head)) & (p <= F.length(head) + F.length(hit))
    in_tail = lambda p: (F.length(tail_hit) > 0) & (p <= n - F.length(tail)) & (p > n - F.length(tail) - F.length(tail_hit))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda p: (in_head(p) | in_tail(p)).cast("int")))


def three_classes(ss8: Column, table: tuple[str, str] = SS8_COMMON) -> Column:
    return F.translate(ss8, *table)


def fold_classes(prob: Column, groups: list[list[int]]) -> Column:
    """Sums of the probabilities of each group of classes (places from 0)."""
    return F.array(*[sum((F.element_at(prob, i + 1) for i in g), F.lit(0.0)) for g in groups])


def most_likely(prob: Column) -> Column:
    """Place of the largest value from 0, the first among equals."""
    return F.array_position(prob, F.array_max(prob)).cast("int") - 1


def grams(seq: Column, n: int = 3) -> Column:
    """All stretches of n letters, one for each start."""
    return F.when(F.length(seq) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(seq) - (n - 1)), lambda i: F.substring(seq, i, F.lit(n))))


def matches(a: Column, b: Column, ignore: str = "-X") -> Column:
    """Equal letters of two aligned sequences, letters in ``ignore`` aside."""
    skip = F.array(*[F.lit(c) for c in ignore])
    return F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: ((x == y) & ~F.array_contains(skip, x)).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def mismatches(a: Column, b: Column, ignore: str = "-X") -> Column:
    """Different letters of two aligned sequences where neither is in ``ignore``."""
    skip = F.array(*[F.lit(c) for c in ignore])
    bad = lambda x, y: ((x != y) & ~F.array_contains(skip, x) & ~F.array_contains(skip, y)).cast("int")
    return F.aggregate(F.zip_with(letters(a), letters(b), bad), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def has_unknown(seq: Column) -> Column:
    return F.upper(seq).contains("X")


def chain_name(i: Column, base: int = 62) -> Column:
    """Number to name over A-Z, a-z, 0-9: one character below ``base``, two from there on."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[:base]
    one = lambda k: F.substring(F.lit(digits), (k + 1).cast("int"), F.lit(1))
    return F.when(i < base, one(i)).otherwise(F.concat(one(F.floor(i / base) - 1), one(F.pmod(i, F.lit(base)))))
