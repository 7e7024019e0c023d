"""Freely typed values to the entries of a reference list (problem 1): a trie of the entries and their aliases, walked
together with a Levenshtein automaton of the typed value."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedloom.functions.text import is_blank
from deedloom.llm.chars import plain

# Other wordings of the reference types, by type code, in several languages.
ALIASES = {
    "section_reference": """section, sections, sec, sect, clause, clauses, cl, numbered clause, internal section, sub-section, subsection,
        sub-clause, subclause, paragraph, para, article, art, § , section number, clause number, Abschnitt, Klausel, Ziffer, Paragraf,
        Artikel, artículo, sección, cláusula, párrafo, section du contrat, alinéa, paragraphe, référence de section,
        sezione, clausola, articolo, sectie, hoofdstuk, artikel, clausule, seção, secção, artigo, sekcja, paragraf, klauzula""",
    "defined_term_reference": """defined term, defined terms, definition, definitions, definitions entry, glossary, glossary term, glossary entry,
        term, term definition, def term, def, capitalised term, definierter Begriff, Begriffsbestimmung, Definition, terme défini,
        définition, término definido, definición, termine definito,
        definizione, gedefinieerde term, definitie, termo definido, definição, definicja""",
    "order_form_reference": """order form, order forms, orderform, order, purchase order, PO, order document, order form no, order form number,
        Bestellformular, Bestellung, Auftragsformular, bon de commande, formulaire de commande, formulario de pedido, orden de compra, modulo d'ordine, bestelformulier,
        formulário de encomenda, formularz zamówienia""",
    "exhibit_reference": """exhibit, exhibits, exh, ex, exhibit attached, attached exhibit, exhibit letter, Beweisstück, pièce jointe, anexo adjunto""",
    "agreement_reference": """agreement, this agreement, the agreement, present agreement, contract, this contract, the contract, the contract itself,
        the agreement itself, present contract, agreement this, contract itself, dieser Vertrag, vorliegender Vertrag, présent contrat,
        le présent contrat, este contrato, presente contrato, questo contratto, presente contratto,
        deze overeenkomst, niniejsza umowa""",
    "other_contract_reference": """other contract, other contracts, other agreement, another contract, another agreement, external contract,
        related contract, related agreement, separate contract, separate agreement, third-party contract, anderer Vertrag,
        autre contrat, otro contrato, altro contratto, andere overeenkomst, outro contrato, inna umowa""",
    "document_reference": """document, documents, doc, docs, documentation, manual, handbook, specification, specification document, spec,
        external document, Dokument, Handbuch, Dokumentation, manuel, documento, documentación""",
    "schedule_reference": """schedule, schedules, sched, annex, annexes, appendix, appendices, annexe, Anhang, Anlage, apéndice, anexo, appendice, allegato, bijlage, załącznik, apêndice""",
    "law_reference": """law, laws, laws and regulations, laws regulations, act, act of parliament, regulation, regulations, statute, statutory,
        statutes, applicable law, applicable laws, legal provision, legal provision statute, legislation, Gesetz, Gesetze, Verordnung,
        loi, loi applicable, ley, ley aplicable, anwendbares Recht, legge, legge applicabile, wetgeving, toepasselijk recht,
        lei, lei aplicável, ustawa""",
    "policy_reference": """policy, policies, company policy, privacy policy, published policy, internal policy, Richtlinie, politique, política, beleid, polityka""",
    "amendment_reference": """amendment, amendments, addendum, addenda, contract amendment, amended by, amending agreement, Änderungsvereinbarung,
        Nachtrag, avenant, enmienda, modificación, emendamento, wijzigingsovereenkomst, aditamento, aneks""",
    "work_statement_reference": """work statement, statement of work, statements of work, SOW, S.O.W., work order, work orders, Arbeitsauftrag,
        Leistungsbeschreibung, cahier des charges, orden de trabajo, bon de travail""",
    "service_level_reference": """service level, service levels, servicelevel, service level agreement, SLA, S.L.A., SLAs, Dienstgüte,
        niveau de service, nivel de servicio""",
    "foregoing_reference": """foregoing, the foregoing, aforesaid, aforementioned, above-mentioned, above mentioned wording, as described above,
        as set out above, as stated above, points back to above, points back, back reference, vorstehend, wie oben beschrieben,
        ce qui précède, susmentionné, lo anterior, antedicho""",
}
# Words around the name of a type that say nothing about which one it is.
LEADING = ("type", "ref", "refs", "reference", "references", "to", "re", "kind")
TRAILING = ("ref", "refs", "type", "no", "nr", "number")
# Digits and signs typed for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

CODE, LABEL, ALIAS = 0, 1, 2


def within(length: int) -> int:
    """The distance allowed for a value of so many letters: short words have too many near neighbours."""
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 11 else 3


def words(value: str) -> list[str]:
    """The words of a typed value: skeleton without accents and case, signs cut, digits among letters read as letters."""
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value)
    s = plain(s.replace("§", " section "))
    out = []
    for w in re.findall(r"[\w@$!]+", s.replace("_", " ")):
        w = w.strip("!")
        if any(c.isalpha() for c in w):
            w = re.sub(r"[@$!]", "", w.translate(LEET)) if re.search(r"[0-9@$!]", w) else w
            out.append(w)
    return out


def locator_like(w: str) -> bool:
    """A letter or roman numeral as it follows the name of a part."""
    return len(w) == 1 or bool(re.fullmatch(r"[ivxl]{2,4}", w))


def cut_reference(w: str) -> bool:
    """The word that follows the name of a type, possibly cut short."""
    return len(w) > 3 and "references".startswith(w)


@dataclass
class Trie:
    """Paths of letters to (priority, entry); a node is [children, entries that end here]."""

    root: list = field(default_factory=lambda: [{}, []])

    def add(self, path: str, priority: int, entry: int) -> None:
        node = self.root
        for c in path:
            node = node[0].setdefault(c, [{}, []])
        if (priority, entry) not in node[1]:
            node[1].append((priority, entry))

    def within(self, word: str, k: int) -> list[tuple[int, int, int]]:
        """(distance, priority, entry) of every path within distance ``k`` of the word (transpositions count 1).

        The automaton's state is the band of 2 ``k`` + 1 cells of the distance table that can still count, cut at ``k`` + 1;
        a branch ends when no cell is left.
        """
        found: list[tuple[int, int, int]] = []
        far, size = k + 1, len(word)
        first = [abs(t - k) if 0 <= t - k <= size else far for t in range(2 * k + 1)]
        todo = [(self.root, 0, first, None, "")]
        while todo:
            node, depth, band, before, last = todo.pop()
            end = size - depth + k  # the cell of the whole word
            if node[1] and 0 <= end < len(band) and band[end] <= k:
                found += [(band[end], p, e) for p, e in node[1]]
            for c, child in node[0].items():
                step = advance(word, depth + 1, band, before, last, c, k)
                if step is not None:
                    todo.append((child, depth + 1, step, band, c))
        return found


def advance(word: str, depth: int, band: list[int], before: list[int] | None, last: str, c: str, k: int) -> list[int] | None:
    """The automaton's next state on letter ``c``: cell ``t`` is the distance of the path to the word's first
    ``depth - k + t`` letters. None when every continuation is too far."""
    far, size = k + 1, len(word)
    new, left, near = [], far, False
    for t in range(2 * k + 1):
        i = depth - k + t
        if i < 0 or i > size:
            d = far
        else:
            d = left + 1
            if t < 2 * k and band[t + 1] + 1 < d:
                d = band[t + 1] + 1
            if i:
                w = word[i - 1]
                if band[t] + (w != c) < d:
                    d = band[t] + (w != c)
                if before is not None and i > 1 and w == last and word[i - 2] == c and before[t] + 1 < d:
                    d = before[t] + 1
            if d > far:
                d = far
            elif d <= k:
                near = True
        new.append(d)
        left = d
    return new if near else None


class Matcher:
    """A reference list (id, code, label, aliases), ready to be asked for typed values. Entries without aliases of their
    own get those of the dictionary ``aliases`` by code."""

    def __init__(self, entries: list[tuple], aliases: dict[str, str] | None = None):
        self.trie = Trie()
        known = ALIASES if aliases is None else aliases
        for ident, code, label, *own in entries:
            listed = own[0] if own else [a.strip() for a in known.get(code, "").split(",")]
            for form, priority in ((code, CODE), (label, LABEL), *((a, ALIAS) for a in listed)):
                path = "".join(words(form))
                if path:
                    self.trie.add(path, priority, ident)
                    if priority != CODE:
                        self.trie.add(path + "reference", priority, ident)

    def hits(self, value: str) -> list[tuple[int, int, int]]:
        """(distance, priority, entry) of every entry within the distance that the value's length allows, in any reading,
        nearest first: on equal distance code before label before alias, then the smallest id."""
        best: dict[int, tuple[int, int, int]] = {}
        for path in self.readings(words(value)):
            for hit in self.trie.within(path, within(len(path))):
                if hit[2] not in best or hit < best[hit[2]]:
                    best[hit[2]] = hit
        return sorted(best.values())

    def match(self, value: str) -> int:
        """The nearest entry, 0 for none."""
        found = self.hits(value)
        return found[0][2] if found else 0

    __call__ = match

    @staticmethod
    def readings(w: list[str]) -> Iterator[str]:
        """The ways a typed value may be read: as it stands, without surrounding words, locators and repetition."""
        seen = set()
        core = list(w)
        while core and (core[0] in LEADING or len(core) > 1 and len(core[0]) == 1 < len(core[1])):
            core = core[1:]
        tails = [core]
        while core and (core[-1] in TRAILING or cut_reference(core[-1]) or (len(core) > 1 and locator_like(core[-1]))):
            core = core[:-1]
            tails.append(core)
        for ws in [w, *tails]:
            half = len(ws) // 2
            for part in (ws, ws[:half] if len(ws) % 2 == 0 and ws[:half] == ws[half:] else ws):
                path = "".join(part)
                if path and path not in seen and path not in LEADING:
                    seen.add(path)
                    yield path


#: Entries with their aliases are sent to the workers in blocks of so many bytes.
BLOCK_BYTES = 4_000_000


def alias_table(spark: SparkSession, aliases: dict[str, str] | None = None) -> DataFrame:
    """(type_code, alias): the wordings of :data:`ALIASES`, or of another dictionary of the same form, as a table."""
    rows = [(code, a.strip()) for code, listed in (ALIASES if aliases is None else aliases).items() for a in listed.split(",")]
    return spark.createDataFrame(rows, "type_code string, alias string")


def entry_table(reference: DataFrame, aliases: DataFrame) -> DataFrame:
    """(type_id, type_code, label, aliases): the reference list with its aliases; entries without id or code are left
    out, aliases of unknown codes, too."""
    rows = reference.where("type_code is not null and type_id is not null").select(F.col("type_id").cast("int").alias("type_id"), "type_code", "label").distinct()
    listed = aliases.where("alias is not null").groupBy("type_code").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return rows.join(listed, "type_code", "left").select("type_id", "type_code", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("aliases", F.array()).alias("aliases"))


def entry_blocks(entries: DataFrame, size: int) -> Iterator[tuple]:
    """The entries in blocks of about ``size`` bytes, each on the driver in its turn: a longer list takes more rounds
    over the values, not more memory."""
    n_bytes = F.octet_length("type_code") + F.octet_length("label") + F.coalesce(F.aggregate("aliases", F.lit(0), lambda a, x: a + F.octet_length(x) + 16), F.lit(0)) + 64
    total = entries.agg(F.sum(n_bytes)).first()[0] or 0
    blocks = max(1, math.ceil(total / size))
    cut = entries.withColumn("_block", F.pmod(F.xxhash64("type_id"), F.lit(blocks)))
    for k in range(blocks):
        rows = cut.where(F.col("_block") == k).collect()
        yield tuple(sorted((r.type_id, r.type_code, r.label, tuple(r.aliases)) for r in rows))


def matches(values: DataFrame, value: str, entries: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(value, type_id, distance, priority): for distinct values every entry within the distance their length allows.

    Every block of entries becomes a trie in each worker and meets all values; values are spread evenly over the tasks,
    since matching, not their volume, is what costs.
    """
    schema = f"`{value}` string, type_id int, distance int, priority int"

    def against(block: tuple) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(list(block))
            for batch in batches:
                rows = [(v, e, d, p) for v in batch.column(0).to_pylist() for d, p, e in match.hits(v)]
                columns = list(zip(*rows)) if rows else [[]] * 4
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[value, "type_id", "distance", "priority"])

        return values.mapInArrow(run, schema)

    spark = values.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = values.select(value).repartition(tasks, value)
    return reduce(DataFrame.unionByName, [against(b) for b in entry_blocks(entries, size)])


def to_match(rows: DataFrame, entries: DataFrame, value: str) -> DataFrame:
    """The rows whose value is neither null nor blank nor exactly a code."""
    codes = entries.select(F.col("type_code").alias(value)).distinct()
    return rows.where(~is_blank(F.col(value))).join(codes, value, "left_anti")


def candidates(rows: DataFrame, reference: DataFrame, value: str, aliases: DataFrame | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """(value, type_id, distance): all entries that each distinct typed value may mean. Values that mean none have no row."""
    entries = entry_table(reference, alias_table(rows.sparkSession) if aliases is None else aliases)
    return matches(to_match(rows.select(value), entries, value).distinct(), value, entries, size).drop("priority")


def typed_references(rows: DataFrame, reference: DataFrame, key: str, value: str, aliases: DataFrame | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """(key, value, type_id) of rows whose value is neither null nor blank nor exactly a code; each key once. The type is
    the nearest of all entries within distance, 0 if there is none.

    Every distinct value is matched once, however many rows have it. The rows then meet the values in an equality join,
    where adaptive execution splits hot values. Rows repeat their values when redelivered, so any row of a key serves.
    ``aliases`` (type_code, alias) replaces the wordings known here.
    """
    entries = entry_table(reference, alias_table(rows.sparkSession) if aliases is None else aliases)
    typed = to_match(rows.select(key, value), entries, value).distinct()
    found = matches(typed.select(value).distinct(), value, entries, size)
    best = found.groupBy(value).agg(F.min_by("type_id", F.struct("distance", "priority", "type_id")).alias("type_id"))
    return typed.join(best, value, "left").select(key, value, F.coalesce("type_id", F.lit(0)).alias("type_id"))


def unmatched_report(matched: DataFrame, value: str) -> DataFrame:
    """(value, n): the values that mean no entry, with the number of rows."""
    return matched.where("type_id = 0").groupBy(value).agg(F.count("*").alias("n"))
