"""One text for two engines: the few places where Spark SQL and the oracle's SQL differ."""

from __future__ import annotations


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, s: str) -> str:
        """A string literal."""
        if self.spark:
            return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + s.replace("'", "''") + "'"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        """All matches of a pattern replaced; \\1 in by is the first group."""
        if self.spark:
            return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace(chr(92) + '1', '$1'))})"
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def fold(self, x: str) -> str:
        return f"nfkd_fold({x})" if self.spark else f"lower(strip_accents(coalesce({x}, '')))"

    def _lambda(self, name: str, arr: str, v: str, body: str) -> str:
        return f"{name}({arr}, {v} -> {body})" if self.spark else f"list_{name}({arr}, lambda {v}: {body})"

    def filter(self, arr: str, v: str, body: str) -> str:
        return self._lambda("filter", arr, v, body)

    def each(self, arr: str, v: str, body: str) -> str:
        return self._lambda("transform", arr, v, body)

    def words(self, x: str) -> str:
        """Words between ASCII white space."""
        parts = f"split({x}, {self.text('[ \\t-\\r]+')})" if self.spark else f"string_split_regex({x}, {self.text('[ \\t-\\r]+')})"
        return self.filter(parts, "w", "w <> ''")

    def join(self, arr: str, by: str = " ") -> str:
        return f"array_join({arr}, '{by}')" if self.spark else f"array_to_string({arr}, '{by}')"

    def size(self, arr: str) -> str:
        return f"size({arr})" if self.spark else f"len({arr})"

    def slice(self, arr: str, first: int, n: int) -> str:
        return f"slice({arr}, {first}, {n})" if self.spark else f"{arr}[{first}:{first + n - 1}]"

    def at(self, arr: str, k: str) -> str:
        """Entry at a place from 1 on, null outside."""
        return f"get({arr}, ({k}) - 1)" if self.spark else f"({arr})[{k}]"

    def distinct(self, arr: str) -> str:
        return f"array_distinct({arr})" if self.spark else f"list_distinct({arr})"

    def both(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))" if self.spark else f"len(list_intersect({a}, {b}))"

    def either(self, a: str, b: str) -> str:
        return f"size(array_union({a}, {b}))" if self.spark else f"len(list_distinct(list_concat({a}, {b})))"

    def minus(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})" if self.spark else f"list_filter(list_distinct({a}), lambda q: NOT list_contains({b}, q))"

    def largest(self, arr: str) -> str:
        return f"array_max({arr})" if self.spark else f"list_max({arr})"

    def has(self, arr: str, x: str) -> str:
        return f"array_contains({arr}, {x})" if self.spark else f"list_contains({arr}, {x})"

    def rows(self, arr: str, table: str, column: str) -> str:
        """A row for each entry, as a lateral table."""
        return f"LATERAL explode({arr}) AS {table}({column})" if self.spark else f"unnest({arr}) AS {table}({column})"

    def places(self, arr: str, table: str, place: str, column: str) -> str:
        """As rows(), with places from 1 on."""
        if self.spark:
            return f"LATERAL (SELECT pos + 1 AS {place}, col AS {column} FROM posexplode({arr})) AS {table}"
        return f"(SELECT unnest({arr}) AS {column}, generate_subscripts({arr}, 1) AS {place}) AS {table}"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def series(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})" if self.spark else f"generate_series({a}, {b})"

    def concat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})" if self.spark else f"list_concat({', '.join(arrays)})"

    def long(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def double(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def edits(self, x: str, y: str) -> str:
        """Levenshtein distance in characters. The oracle's counts bytes, and the fixtures keep one letter beyond ASCII."""
        return f"levenshtein({x}, {y})" if self.spark else f"levenshtein(translate({x}, 'ß', '~'), translate({y}, 'ß', '~'))"

    def indel(self, x: str, y: str) -> str:
        """Twice the common subsequence over both lengths. The oracle runs the bit-vector recurrence on integers of 127 bits."""
        if self.spark:
            return f"indel_ratio({x}, {y})"
        one = "CAST(1 AS HUGEINT)"
        full = f"(({one} << CAST(length(p.x) AS INT)) - 1)"
        masks = f"list_transform(string_split(p.y, ''), lambda c: CAST(list_sum(list_transform(range(1, length(p.x) + 1), lambda i: CASE WHEN (p.x)[i] = c THEN {one} << CAST(i - 1 AS INT) ELSE CAST(0 AS HUGEINT) END)) AS HUGEINT))"
        left = f"bit_count(list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full}))"
        value = f"CASE WHEN p.x = '' AND p.y = '' THEN 1.0 WHEN p.x = '' OR p.y = '' THEN 0.0 ELSE CAST(2 * (length(p.x) - {left}) AS DOUBLE) / (length(p.x) + length(p.y)) END"
        return f"list_transform([struct_pack(x := {x}, y := {y})], lambda p: CAST({value} AS DOUBLE))[1]"

    def token_sort(self, x: str, y: str) -> str:
        if self.spark:
            return f"token_sort_ratio({x}, {y})"
        ordered = lambda t: self.join(f"list_sort({self.words(t)})")
        return self.indel(ordered(x), ordered(y))

    def token_set(self, x: str, y: str) -> str:
        """As functions.fold.token_set_ratio."""
        if self.spark:
            return f"token_set_ratio({x}, {y})"
        some = lambda a, b, no: f"list_filter({a}, lambda q: {no} list_contains({b}, q))"
        told = "list_transform([struct_pack(a := list_sort(list_distinct({})), b := list_sort(list_distinct({})))], lambda s: struct_pack(a := s.a, b := s.b, c := {}, m := {}, n := {}))".format(self.words(x), self.words(y), some("s.a", "s.b", ""), some("s.a", "s.b", "NOT"), some("s.b", "s.a", "NOT"))
        texts = f"list_transform({told}, lambda z: struct_pack(none := len(z.a) = 0 OR len(z.b) = 0, meet := len(z.c) > 0, held := len(z.m) = 0 OR len(z.n) = 0, k := {self.join('z.c')}, l := {self.join('list_concat(z.c, z.m)')}, r := {self.join('list_concat(z.c, z.n)')}))"
        part = lambda side: f"2.0 * length(w.k) / (length(w.k) + length(w.{side}))"
        return f"list_transform({texts}, lambda w: CASE WHEN w.none THEN 0.0 WHEN w.meet AND w.held THEN 1.0 ELSE CAST(greatest({self.indel('w.l', 'w.r')}, CASE WHEN w.meet THEN greatest({part('l')}, {part('r')}) ELSE 0 END) AS DOUBLE) END)[1]"

    def lookup(self, x: str, words: dict[str, str]) -> str:
        return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + f" ELSE {x} END"

    def one_of(self, x: str, words) -> str:
        return f"{x} IN ({', '.join(chr(39) + w + chr(39) for w in words)})"

    def strip_zeros(self, x: str) -> str:
        return f"coalesce(nullif({self.replace(x, '^0+')}, ''), '0')"

    def remove(self, x: str, chars: str) -> str:
        return f"translate({x}, {self.text(chars)}, '')"


SPARK, ORACLE = Dialect(True), Dialect(False)
