"""How DuckDB spells what the oracles need."""

from __future__ import annotations


class Duck:
    dir = ""

    def t(self, name: str) -> str:
        return name

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def stamp(self, ts: str) -> str:
        return f"strftime({ts}, '%a %b %d %H:%M:%S %Y')"

    def sorted_list(self, x: str) -> str:
        return f"list_sort(list({x}))"

    def at(self, array: str, k: str) -> str:
        return f"({array})[CAST({k} AS INT)]"

    def joined(self, x: str, order: str) -> str:
        return f"string_agg(CAST({x} AS VARCHAR), ',' ORDER BY {order})"

    def bin_xor(self, a: str, b: str) -> str:
        return f"lpad(bin(xor(CAST(CAST({a} AS BIT) AS BIGINT), CAST(CAST({b} AS BIT) AS BIGINT))), 64, '0')"

    def extract(self, s: str, pattern: str, g: int = 0) -> str:
        return f"regexp_extract({s}, '{pattern}', {g})"

    def replace(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, '{pattern}', '{to}', 'g')"

    def matches(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, '{pattern}')"

    def parse(self, s: str) -> str:
        return f"strptime({s}, '%b %d %H:%M:%S %Y')"

    def octets(self, s: str) -> str:
        return f"octet_length(encode({s}))"
