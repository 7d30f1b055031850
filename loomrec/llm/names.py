"""Operator 11: a join of names by unrestricted Damerau-Levenshtein distance, by descent of tries.

Equal names are one row on each side. Names of one side are dealt to shards by their length and
by a piece of their text that some name within the distance must share: ``most`` edits leave
one of most + 1 pieces, parted by single characters, as it is. A name of the other side visits
the shards of lengths within the distance whose piece it holds where the piece may have moved
to. A shard builds a trie of its names; a visitor goes down with a row of the distance table a
node, so that names share the rows of their common prefix. Rows on the way are kept for
exchanges, which look back past the row before; a branch ends where its row exceeds ``most``.
Large shards are cut into blocks by hash, and blocks of names meet blocks of visitors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import materialize, partitions_for, release, tidy

#: Names, or visitors, of a shard that meet in one call; beyond this a shard is cut.
BLOCK_NAMES = 4096
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"


def form(name: Column) -> Column:
    """A name with A-Z in lower case and without white space of ASCII."""
    return F.translate(name, CAPITALS + SPACES, SMALL)


def misspelt(name: Column, key: Column) -> Column:
    """name with two neighbours exchanged, at a place that a hash of key tells, for every second hash."""
    h, n = F.crc32(key.cast("string").cast("binary")), F.char_length(name)
    at = (F.pmod(h, F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.lit(1)), F.substring(name, at, F.lit(1)), F.substring(name, at + 2, n))
    return F.when((F.pmod(h, F.lit(2)) == 0) & (n >= 2), swapped).otherwise(name)


def pieces(length: int, most: int) -> list[tuple[int, int]]:
    """Start and size of the most + 1 pieces of a name, with a character between each two.

    An edit touches characters next to each other at most, and so one piece; to bring two pieces
    together takes an edit of what parts them. So most edits leave a piece that they don't touch.
    Pieces of a short name may be empty.
    """
    size = max(0, length - most)
    cuts = [k * size // (most + 1) for k in range(most + 2)]
    return [(min(length, cuts[k] + k), cuts[k + 1] - cuts[k]) for k in range(most + 1)]


def _piece_keys(most: int):
    """Names to the keys of their shards: length, piece and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name in batch.column("name").to_pylist():
                out += [(len(name), k, name[a : a + n], name) for k, (a, n) in enumerate(pieces(len(name), most))]
            yield _batch(out, KEYS)

    return run


def _windows(name: str, length: int, piece: int, start: int, size: int, most: int) -> list[int]:
    """Where a piece of a name of some length may stand in name."""
    last = len(name) - size
    if piece == 0:  # nothing before it has changed: edits are all behind the first piece, or touch it
        low, high = (0, 0) if most == 1 else (start - most, start + most)
    elif piece == most == 1:  # nothing behind it has changed
        low = high = start + len(name) - length
    else:
        low, high = start - most, start + most
    return list(range(max(0, low), min(last, high) + 1))


def _visits(most: int):
    """Names to the keys of the shards that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name in batch.column("name").to_pylist():
                keys = set()
                for length in range(max(1, len(name) - most), len(name) + most + 1):
                    for k, (a, n) in enumerate(pieces(length, most)):
                        keys.update((length, k, name[w : w + n]) for w in _windows(name, length, k, a, n, most))
                out += [(*key, name) for key in keys]
            yield _batch(out, KEYS)

    return run


KEYS = "length int, piece int, part string, name string"
PAIRS = "name string, visitor string, distance int"
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


class Trie:
    """Names by their characters: children of each node, and the names that end there."""

    def __init__(self, names: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for name in names:
            at = 0
            for c in name:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                at = self.children[at][c]
            self.ends[at] = name

    def within(self, visitor: str, most: int) -> list[tuple[str, int]]:
        """The names whose distance to visitor is at most most, each with it.

        Row i holds the distances of the path's first i characters to the first j of visitor,
        for j from i - most to i + most; all others exceed most. An exchange reaches back to the
        last rows and columns where its two characters stood, most of them at most, as what lies
        between counts as edits. Any way on through an exchange that pays passes a cell of the
        row in between of no greater value, so a row that exceeds most ends its branch.
        """
        over, width, n = most + 1, 2 * most + 1, len(visitor)
        rows = [[min(over, max(0, t - most)) if 0 <= t - most <= n else over for t in range(width)]]
        path: list[str] = []
        found = []
        if self.ends[0] is not None and n <= most:
            found.append((self.ends[0], n))
        stack = [(node, 1, c) for c, node in self.children[0].items()]
        while stack:
            node, i, c = stack.pop()
            del rows[i:], path[i - 1 :]
            path.append(c)
            row = _row(rows, path, visitor, i, most)
            if min(row) > most:
                continue
            rows.append(row)
            end = self.ends[node]
            t = n - i + most
            if end is not None and 0 <= t < width and row[t] <= most:
                found.append((end, row[t]))
            stack += [(child, i + 1, d) for d, child in self.children[node].items()]
        return found


def _row(rows: list[list[int]], path: list[str], visitor: str, i: int, most: int) -> list[int]:
    """The next row of the table, from the earlier ones of its path; the cell t is that of column i - most + t."""
    over, width, n = most + 1, 2 * most + 1, len(visitor)
    before, c = rows[i - 1], path[i - 1]
    row = [over] * width
    for t in range(width):
        j = i - most + t
        if j < 0 or j > n:
            continue
        if j == 0:
            row[t] = min(over, i)
            continue
        d = before[t] + (visitor[j - 1] != c)
        if t + 1 < width and before[t + 1] + 1 < d:
            d = before[t + 1] + 1
        if t and row[t - 1] + 1 < d:
            d = row[t - 1] + 1
        # the last column before j that holds c, and the last row before i that holds visitor's j-th
        for col in range(j - 1, max(0, j - most - 1), -1):
            if visitor[col - 1] == c:
                for r in range(i - 1, max(0, i - most - 1), -1):
                    if path[r - 1] == visitor[j - 1]:
                        at = col - r + most
                        if 0 <= at < width:
                            d = min(d, rows[r - 1][at] + (i - r) + (j - col) - 1)
                        break
                break
        row[t] = min(d, over)
    return row


def _earlier(name: str, visitor: str, piece: int, most: int) -> bool:
    """Whether an earlier piece brings the two together, too."""
    for k, (a, n) in enumerate(pieces(len(name), most)[:piece]):
        part = name[a : a + n]
        if any(visitor[w : w + n] == part for w in _windows(visitor, len(name), k, a, n, most)):
            return True
    return False


def _met(most: int):
    """Blocks of shards, sorted by key with names before visitors, to the pairs within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie, names = None, None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("length", "piece", "part", "chunk", "slice", "visits", "name")]
            for *own, visits, name in zip(*columns, strict=True):
                if own != key:
                    key, trie, names = own, None, []
                if not visits:
                    names.append(name)
                    continue
                trie = trie or Trie(names)
                out += [(x, name, d) for x, d in trie.within(name, most) if not _earlier(x, name, own[1], most)]
            yield _batch(out, PAIRS)

    return run


def near_names(left: DataFrame, right: DataFrame, most: int = 1, block_names: int = BLOCK_NAMES) -> DataFrame:
    """name (of left), visitor (of right) and distance of every pair of distinct names whose distance is at most most.

    left and right have the column name; null and empty names take no part.
    """
    own, other = (x.where("name is not null and name <> ''").select("name").distinct() for x in (left, right))
    shard = ["length", "piece", "part"]
    names = materialize(own.mapInArrow(tidy(_piece_keys(most)), KEYS), "names")
    visits = materialize(other.mapInArrow(tidy(_visits(most)), KEYS), "visits")
    # only shards with names and visitors are built; how many of each they have tells in how many blocks
    sizes = names.groupBy(*shard).agg(F.count("*").alias("x")).join(visits.groupBy(*shard).agg(F.count("*").alias("y")).hint("merge"), shard)
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block_names)).cast("int")
    sizes = materialize(sizes.select(*shard, blocks("x").alias("chunks"), blocks("y").alias("slices")), "shards")
    deal = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a large shard's rows are many of one key: adaptive execution splits this join
    a = names.join(sizes.hint("merge"), shard).select(*shard, deal("chunks").alias("chunk"), every("slices").alias("slice"), F.lit(False).alias("visits"), "name")
    b = visits.join(sizes.hint("merge"), shard).select(*shard, every("chunks").alias("chunk"), deal("slices").alias("slice"), F.lit(True).alias("visits"), "name")
    block = [*shard, "chunk", "slice"]
    dealt = a.unionByName(b).repartition(partitions_for(names.unionByName(visits)), *block).sortWithinPartitions(*block, "visits")
    found = materialize(dealt.mapInArrow(tidy(_met(most)), PAIRS), "near")
    release(names, visits, sizes)
    return found


def join_names(clients: DataFrame, vendors: DataFrame, most: int = 1, block_names: int = BLOCK_NAMES) -> DataFrame:
    """vendor_id, distance, n_clients, first_client_id and clients_crc of vendors' names, misspelt, and clients' names in their forms.

    One row for each vendor_id and distance up to most at which there are clients. Names that
    are null, or empty in their form, take no part, nor do rows without an id. Every row counts:
    a client listed twice counts twice, and a vendor_id with several rows sums up their clients.
    Names are taken whole. Other columns are ignored; an empty table gives an empty result.
    """
    left = clients.where("client_id is not null").select(form(F.col("name")).alias("name"), F.col("client_id").cast("long").alias("client_id"))
    left = left.where("name <> ''").groupBy("name").agg(F.count("*").alias("n"), F.min("client_id").alias("first"), F.sum(F.crc32(F.col("client_id").cast("string").cast("binary"))).alias("crc"))
    left = materialize(left, "clients")
    right = vendors.where("vendor_id is not null").select(form(misspelt(F.col("name"), F.col("vendor_id").cast("long"))).alias("visitor"), F.col("vendor_id").cast("long").alias("vendor_id"))
    right = right.where("visitor <> ''").groupBy("visitor", "vendor_id").agg(F.count("*").alias("times"))
    right = materialize(right, "vendors")
    found = near_names(left, right.select(F.col("visitor").alias("name")), most, block_names)
    per = found.join(left.hint("merge"), "name").groupBy("visitor", "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
    # a name that many vendors share is many rows of one key on that side alone: adaptive execution splits it
    out = right.join(per.hint("merge"), "visitor").groupBy("vendor_id", "distance")
    return out.agg(F.sum(F.col("n") * F.col("times")).alias("n_clients"), F.min("first").alias("first_client_id"), F.sum(F.col("crc") * F.col("times")).alias("clients_crc"))


def _crc_sql(number: str) -> str:
    """The unsigned crc32 of a number's decimal digits; needs crc_table among the tables it is taken from."""
    return f"""xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast({number} as varchar), ''), lambda c: cast(ascii(c) as bigint))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"""


_FORM = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz')"
_DIGIT = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
ORACLE = f"""with recursive bits(i, k, x) as (select i, 0, i from range(256) r(i) union all select i, k + 1, {_DIGIT} from bits where k < 8),
crc_table as (select list(x order by i) as t from bits where k = 8),
c0 as (select {_FORM.format('name')} as name, client_id, {_crc_sql('client_id')} as crc from clients, crc_table where client_id is not null and name is not null),
c as (select name, count(*) as n, min(client_id) as first, sum(crc) as crc from c0 where name <> '' group by name),
v0 as (select vendor_id, name, {_crc_sql('vendor_id')} as h, length(name) as l from vendors, crc_table where vendor_id is not null and name is not null),
v1 as (select vendor_id, case when h % 2 = 0 and l >= 2 then substr(name, 1, h % (l - 1)) || substr(name, h % (l - 1) + 2, 1) || substr(name, h % (l - 1) + 1, 1) || substr(name, h % (l - 1) + 3) else name end as name from v0),
v as (select vendor_id, {_FORM.format('name')} as name from v1 where {_FORM.format('name')} <> ''),
w as (select distinct name from v),
cut_c as (select name, i, substr(name, 1, i - 1) || substr(name, i + 1) as rest from (select name, unnest(range(1, length(name) + 1)) as i from c)),
cut_w as (select name, i, substr(name, 1, i - 1) || substr(name, i + 1) as rest from (select name, unnest(range(1, length(name) + 1)) as i from w)),
turned as (select name, substr(name, 1, i - 1) || substr(name, i + 1, 1) || substr(name, i, 1) || substr(name, i + 2) as other from (select name, unnest(range(1, length(name))) as i from w)),
near as (select w.name as visitor, c.name, 0 as distance from w join c using (name)
  union select visitor, name, 1 from (
    select x.name as visitor, y.name from cut_w x join cut_c y on x.rest = y.rest and x.i = y.i
    union select x.name, c.name from cut_w x join c on c.name = x.rest
    union select w.name, y.name from w join cut_c y on w.name = y.rest
    union select t.name, c.name from turned t join c on c.name = t.other) where visitor <> name)
select vendor_id, cast(distance as integer) as distance, cast(sum(n) as bigint) as n_clients, min(first) as first_client_id, cast(sum(crc) as bigint) as clients_crc
from v join near on near.visitor = v.name join c on c.name = near.name group by all"""
