from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import pytest
from compare import duckdb_over, duckdb_rows, spark_rows
from pyspark.sql import functions as F

from tallyloom.llm import repair_grammar as grammar
from tallyloom.llm import structure_repair
from tallyloom.llm.queries import ORACLE_SQL, op11_structure_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, symbols string, part int, digest string"
SPACE = "\t\n\x0b\x0c\r "
WANTED = re.compile("(s?(ua)+)?")


@pytest.fixture
def conversations(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)

    return build


def cheapest(symbols: str) -> tuple[int, str]:
    """Least (cost, audit) by trying every edit from every state, row by row from the end."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @cache
    def best(row, state, inserted):
        found = [(0, "")] if row == len(symbols) and state in ("", "a") else []

        def then(cost, edit, *rest):
            more, audit = best(*rest)
            found.append((cost + more, edit + audit))

        if inserted < 3:
            for role in "ua":
                if (state, role) in steps:
                    then(2, "I", row, steps[state, role], inserted + 1)
        if row < len(symbols):
            then(3, "D", row + 1, state, 0)
            extra, letter = int(symbols[row].isupper()), symbols[row].lower()
            for role, cost, edit in ((letter, 0, "K"), ("u", 2, "R"), ("a", 2, "R")):
                if letter != "d" and (state, role) in steps:
                    then(cost + extra, edit, row + 1, steps[state, role], 0)
        return min(found, default=(10**9, ""))

    for row in range(len(symbols), 0, -100):  # keeps the recursion shallow
        for state in ("", "s", "u", "a"):
            best(row, state, 0)
    return best(0, "", 0)


def every_script(symbols: str) -> tuple[int, str]:
    """The same by writing out every sequence of edits with at most two insertions in a place."""
    found = []

    def go(row, output, cost, audit, inserted):
        if not re.fullmatch("s?(ua)*u?", output) and output:
            return
        if row == len(symbols):
            if WANTED.fullmatch(output):
                found.append((cost, audit))
        else:
            go(row + 1, output, cost + 3, audit + "D", 0)
            if symbols[row] != "d":
                extra, letter = int(symbols[row].isupper()), symbols[row].lower()
                go(row + 1, output + letter, cost + extra, audit + "K", 0)
                for role in "ua":
                    go(row + 1, output + role, cost + extra + 2, audit + "R", 0)
        if inserted < 2:
            for role in "ua":
                go(row, output + role, cost + 2, audit + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return min(found)


def wanted(rows) -> dict:
    """Brute force over plain lists: conv_id to the report and the digest of the repaired lines."""
    found = {}
    for conv_id in {r[0] for r in rows}:
        own = [(turn, role or " " if role is None else role, " " if text is None else text) for c, turn, role, text in rows if c == conv_id]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, symbols, blank, duplicate, truncated = set(), "", 0, 0, 0
        for _, role, text in own:
            body = text.rstrip(SPACE)
            if not body:
                blank, symbols = blank + 1, symbols + "d"
            elif (role, text) in seen:
                duplicate, symbols = duplicate + 1, symbols + "d"
            else:
                letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
                is_cut = body[-1] not in ".!?"
                truncated, symbols = truncated + is_cut, symbols + (letter.upper() if is_cut else letter)
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(symbols)
        lines, row, last = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[row][1:]
            row += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found[conv_id] = (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)
    return found


def result(frame, scratch) -> dict:
    found = structure_repair.repair(frame, scratch)
    empty = hashlib.sha256(b"").hexdigest()
    digests = {r.conv_id: r.sha256 for r in structure_repair.text_digests(found.rows).collect()}
    return {
        r.conv_id: (
            *(r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit),
            digests.get(r.conv_id, empty),
        )
        for r in found.report.collect()
    }


def some_rows(rnd, conv_id, number):
    texts = ["Fine.", "Yes!", "cut", "cut ", "", " \t\n", "Why?\n", "é.", "\x00", " ", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "User", "", "student", None]
    rows, turn = [], 0
    for _ in range(number):
        turn += rnd.choice([0, 1, 1, 1, 3])
        role = rnd.choice(roles) if rnd.random() < 0.3 else ("user", "assistant")[turn % 2]
        rows.append((conv_id, rnd.choice([turn, turn, turn, None]), role, rnd.choice(texts) or rnd.choice([None, "", f"t {turn}."])))
    return rows


def test_equals_brute_force(conversations, scratch):
    rnd = random.Random(7)
    rows = [row for conv in range(150) for row in some_rows(rnd, conv, rnd.randint(1, 9))]
    rows += some_rows(rnd, None, 12) + [(-5, 3, "user", "same.")] * 6
    rnd.shuffle(rows)
    assert result(conversations(rows).repartition(5), scratch) == wanted(rows)


def test_pieces_of_a_conversation_in_many_tasks(conversations, scratch, monkeypatch):
    """One conversation holds nearly all rows; its rows lie in several tasks and pieces."""
    monkeypatch.setattr(structure_repair, "PIECE_ROWS", 7)
    rnd = random.Random(8)
    rows = some_rows(rnd, 1, 300) + some_rows(rnd, 2, 3) + [(1, 40, "user", "again.")] * 50
    rows += [(3, None, "user", f"{i % 40}.") for i in range(90)]  # one turn only
    rnd.shuffle(rows)
    spark = scratch.spark
    changed = {"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        found = structure_repair.repair(conversations(rows), scratch)
        assert found.rows.filter("conv_id = 1").select("part").distinct().count() > 2
        assert result(conversations(rows), scratch) == wanted(rows)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_empty_table_and_long_texts(conversations, scratch):
    assert result(conversations([]), scratch) == {}
    rows = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "word " * 300_000), (2, 0, "u" * 5_000, "x.")]
    assert result(conversations(rows), scratch) == wanted(rows)


def test_repaired_rows(conversations, scratch):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 4, "user", "So")]
    found = structure_repair.repair(conversations(rows), scratch)
    (report,) = found.report.collect()
    assert (report.gaps, report.duplicate, report.truncated, report.illegal) == (2, 1, 1, 2)
    in_order = [(r.role, r.text) for r in found.rows.orderBy("part", "seq", "place").collect()]
    # deleting the greeting and inserting a user row before it differ in cost
    assert (report.cost, report.audit) == cheapest("auDU".replace("D", "d"))
    assert "".join(role[0] for role, _ in in_order) == "uaua"[: len(in_order)]


def test_grammar_equals_row_by_row():
    rnd = random.Random(3)
    for _ in range(60):
        weights = [rnd.random() for _ in grammar.SYMBOLS]
        strings = [
            "".join(rnd.choices(grammar.SYMBOLS, weights, k=rnd.randint(1, 14))) for _ in range(rnd.randint(1, 25))
        ]
        for string, matrix in zip(strings, grammar.matrices(strings), strict=True):
            fold = grammar.Fold()
            fold.add([cell and (cell[0], cell[1].flat()) for cell in matrix])
            cost, audits = fold.result()
            assert (cost, "".join(text for _, text in audits)) == cheapest(string)


def test_row_by_row_equals_every_script():
    rnd = random.Random(4)
    for _ in range(60):
        string = "".join(rnd.choices(grammar.SYMBOLS, k=rnd.randint(0, 4)))
        assert cheapest(string) == every_script(string)


def test_pieces_fold_to_the_whole():
    rnd = random.Random(5)
    for _ in range(200):
        string = "".join(rnd.choices("suaxSUAXdduaua", k=rnd.randint(1, 20)))
        cuts = sorted(rnd.sample(range(1, len(string) + 1), rnd.randint(0, min(4, len(string)))))
        parts = [string[a:b] for a, b in zip([0, *cuts], [*cuts, len(string)]) if a < b]
        fold = grammar.Fold()
        for matrix in grammar.matrices(parts):
            fold.add([cell and (cell[0], cell[1].flat()) for cell in matrix])
        cost, audits = fold.result()
        assert (cost, "".join(text for _, text in audits)) == cheapest(string)
        letters = ""
        for (state, text), part in zip(audits, parts, strict=True):
            for edit, row, role in grammar.edits(text, state, part):
                if edit != "D":
                    letters += role or part[row].lower()
        assert WANTED.fullmatch(letters)


def test_rules_spell_the_strings():
    rnd = random.Random(6)
    for _ in range(100):
        strings = ["".join(rnd.choices("suad", k=rnd.randint(0, 30))) for _ in range(rnd.randint(1, 6))]
        strings.append("d" * rnd.randint(1, 40))
        sequences, rules = grammar.re_pair(strings)

        def spell(symbol):
            if symbol < len(grammar.SYMBOLS):
                return grammar.SYMBOLS[symbol]
            return "".join(map(spell, rules[symbol - len(grammar.SYMBOLS)]))

        assert ["".join(map(spell, sequence)) for sequence in sequences] == strings
        pairs = [pair for sequence in sequences for pair in zip(sequence, sequence[1:])]
        assert all(pairs.count(pair) == 1 or pair[0] == pair[1] for pair in pairs)


def test_long_string_keeps_its_ropes_flat():
    (matrix,) = grammar.matrices(["ua" * 20_000 + "d"])
    fold = grammar.Fold()
    fold.add([cell and (cell[0], cell[1].flat()) for cell in matrix])
    assert fold.result() == (3, [(0, "K" * 40_000 + "D")])


def test_equals_sql_on_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    found = spark_rows(op11_structure_repair(spark, folder))
    assert found == duckdb_rows(duckdb_over(folder), ORACLE_SQL["op11_structure_repair"])


def test_sql_on_nulls_and_conversations_that_vanish(spark, tmp_path):
    """The whole query, damage included, on hand-made rows: some conversations lose every row."""
    rnd = random.Random(11)
    rows = [row for conv in range(80) for row in some_rows(rnd, conv, rnd.choice([1, 1, 4, 8]))]
    rows += some_rows(rnd, None, 9)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    # rows of one turn are ordered by their first characters, then by digest
    frame = frame.dropDuplicates(["conv_id", "turn", "role", "text"])
    frame.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    found = op11_structure_repair(spark, str(tmp_path))
    import duckdb

    connection = duckdb.connect()
    connection.execute(
        f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')"
    )
    assert spark_rows(found) == duckdb_rows(connection, ORACLE_SQL["op11_structure_repair"])
    assert found.filter((F.col("audit") == "") & (F.col("cost") == 0)).count() > 0
