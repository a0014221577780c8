"""One expression in two dialects of SQL: Spark's, which runs, and that of the oracle, which it is compared with."""

from __future__ import annotations

import unicodedata


def _accents() -> tuple[str, str]:
    """Letters below U+0250 that are one ASCII letter without their marks, and those."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare.isascii() and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accents()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: How many sets of keys a table of values holds that is broadcast; rows with other keys are worked on where they are.
COMMON = 20_000


class Spark:
    name = "spark"

    def pattern(self, p: str) -> str:
        return 'r"' + p.replace('"', "\\x22") + '"'

    def replace(self, x: str, p: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {quoted(by)})"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def like(self, x: str, p: str) -> str:
        return f"({x} rlike {self.pattern(p)})"

    def count(self, x: str, p: str) -> str:
        return f"cast(regexp_count({x}, {self.pattern(p)}) as bigint)"

    def accents(self, x: str) -> str:
        return f"translate(regexp_replace({x}, r'[\\u0300-\\u036f]', ''), {quoted(ACCENTED)}, {quoted(BARE)})"

    def words(self, x: str, most: int | None = None) -> str:
        split = f"filter(split({x}, ' '), w -> w <> '')"
        return f"slice({split}, 1, {most})" if most else split

    def each(self, words: str, of: str) -> str:
        return f"array_join(transform({words}, w -> {of}), ' ')"

    def any(self, words: str, of: str) -> str:
        return f"exists({words}, w -> {of})"

    def size(self, words: str) -> str:
        return f"cast(size({words}) as bigint)"

    def once(self, source: str, keep: str, **made: str) -> str:
        """keep, and expressions over the rows of source; a generator, so that the optimizer doesn't copy them into each place that reads them."""
        named = ", ".join(f"'{k}', {v}" for k, v in made.items())
        return f"select {keep}, {', '.join(f't.{k}' for k in made)} from {source} lateral view inline(array(named_struct({named}))) t"

    def mapped(self, source: str, keep: str, keys: tuple[str, ...], **made: str) -> str:
        """keep (of s, the source), and expressions over its keys, which are evaluated once for each of the most common sets of keys."""
        return self._looked_up(f"{source} s", source, "s.", keep, {k: (keys, v) for k, v in made.items()})

    def over(self, source: str, keep: str, **made: tuple[tuple[str, ...], str]) -> str:
        """keep, and expressions with the keys that they are over, each evaluated once for each of the most common sets of its keys; without keys, in each row."""
        return self._looked_up(source, source, f"{source}.", keep, made)

    def _looked_up(self, rows: str, source: str, of: str, keep: str, made: dict[str, tuple[tuple[str, ...], str]]) -> str:
        """The COMMON most frequent sets of keys are a table that is broadcast, so that no row moves and no task gets all rows of a value; what a row has else is evaluated in place."""
        groups: dict[tuple[str, ...], dict[str, str]] = {}
        for k, (keys, v) in made.items():
            groups.setdefault(keys, {})[k] = v
        joins, views = [], []
        for i, (keys, values) in enumerate(groups.items()):
            named = ", ".join(f"'v{i}_{k}', {v}" for k, v in values.items())
            if not keys:
                views.append(f"lateral view inline(array(named_struct({named}))) t{i}")
                continue
            known = ", ".join(f"'v{i}_{k}', m{i}.w{i}_{k}" for k in values)
            common = f"select {', '.join(keys)} from (select {', '.join(keys)}, count(*) as n_rows from {source} group by {', '.join(keys)} order by n_rows desc limit {COMMON})"
            table = f"select {', '.join(f'q.{k} as k{i}_{k}' for k in keys)}, true as found{i}, {', '.join(f'u.v{i}_{k} as w{i}_{k}' for k in values)} from ({common}) q lateral view inline(array(named_struct({named}))) u"
            joins.append(f"left join ({table}) m{i} on {' and '.join(f'{of}{k} <=> m{i}.k{i}_{k}' for k in keys)}")
            views.append(f"lateral view inline(if(m{i}.found{i}, array(named_struct({known})), array(named_struct({named})))) t{i}")
        place = {k: i for i, values in enumerate(groups.values()) for k in values}
        hint = f"/*+ broadcast({', '.join(f'm{i}' for i, keys in enumerate(groups) if keys)}) */"
        return f"select {hint} {keep}, {', '.join(f't{place[k]}.v{place[k]}_{k} as {k}' for k in made)} from {rows} {' '.join(joins)} {' '.join(views)}"

    def lookup(self, x: str, values: dict[str, str], other: str) -> str:
        """The value (an SQL literal) of x, else other; x is evaluated once, where a case would do so for each key."""
        return f"coalesce(element_at(map({', '.join(f'{quoted(k)}, {v}' for k, v in values.items())}), {x}), {other})"

    def numbered(self, source: str, n: int, number: str) -> str:
        """Each row n times, with a number from 1."""
        return f"select *, explode(sequence(1, {n})) as {number} from {source}"


class Oracle(Spark):
    name = "oracle"

    def pattern(self, p: str) -> str:
        return quoted(p)

    def replace(self, x: str, p: str, by: str = "") -> str:
        return f"regexp_replace({x}, {quoted(p)}, {quoted(by)}, 'g')"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {quoted(p)}, {group})"

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {quoted(p)})"

    def count(self, x: str, p: str) -> str:
        return f"cast(len(regexp_extract_all({x}, {quoted(p)})) as bigint)"

    def accents(self, x: str) -> str:
        return f"strip_accents({x})"

    def words(self, x: str, most: int | None = None) -> str:
        split = f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
        return f"list_slice({split}, 1, {most})" if most else split

    def each(self, words: str, of: str) -> str:
        return f"coalesce(array_to_string(list_transform({words}, lambda w: {of}), ' '), '')"

    def any(self, words: str, of: str) -> str:
        return f"(len(list_filter({words}, lambda w: {of})) > 0)"

    def size(self, words: str) -> str:
        return f"cast(len({words}) as bigint)"

    def once(self, source: str, keep: str, **made: str) -> str:
        return f"select {keep}, {', '.join(f'{v} as {k}' for k, v in made.items())} from {source}"

    def mapped(self, source: str, keep: str, keys: tuple[str, ...], **made: str) -> str:
        return f"select {keep}, {', '.join(f'{v} as {k}' for k, v in made.items())} from {source} s"

    def over(self, source: str, keep: str, **made: tuple[tuple[str, ...], str]) -> str:
        return self.once(source, keep, **{k: v for k, (_, v) in made.items()})

    def lookup(self, x: str, values: dict[str, str], other: str) -> str:
        return f"case {x} {' '.join(f'when {quoted(k)} then {v}' for k, v in values.items())} else {other} end"

    def numbered(self, source: str, n: int, number: str) -> str:
        return f"select *, cast(unnest(range(1, {n + 1})) as int) as {number} from {source}"


SPARK, ORACLE = Spark(), Oracle()
