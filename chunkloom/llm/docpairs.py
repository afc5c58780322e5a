"""Functions paired with their documentation.

A packrat grammar per language splits a chunk into header, leading comments, definition and docstring with
source offsets; the semantic action keeps what belongs to the definition; an informativeness filter then
drops documentation that says no more than the names do.
"""

from __future__ import annotations

import ast
import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkloom.llm.peg import Grammar, Node, find
from chunkloom.session import spread

FUNCTION_TYPES = ("function", "method", "free_function")

PYTHON = r"""
Chunk <- FileLine? Context* Lead* Def
FileLine <- ~'# File:[^\n]*\n?'
Context <- !Lead !DefStart ~'[^\n]*\n'
Lead <- Comment / Decorator / Gap
Gap <- ~'[ \t\f\r]*\n'
Comment <- ~'[ \t]*#[^\n]*\n'
Decorator <- ~'[ \t]*@[ \t]*[\w.]+' Group? ~'[^\n]*\n'
DefStart <- ~'[ \t]*(?:async[ \t]+)?def[ \t]+'
Def <- DefStart Signature Suite / DefStart FirstLine Suite
Signature <- Name ~'[ \t]*' TypeParams? Group ~'[ \t]*' (~'->' (Group / ~'[^:\n(\[{]+')+)? ':'
FirstLine <- ~'[^\n]*'
Name <- ~'\w+'
TypeParams <- '[' (Group / ~'[^\[\]]')* ']'
Group <- '(' Inner* ')' / '[' Inner* ']' / '{' Inner* '}'
Inner <- String / Group / ~'#[^\n]*' / ~'[^()\[\]{}"\'#]+'
Suite <- ~'[ \t]*' (Docstring / (~'(?:#[^\n]*)?\r?\n' (Gap / Comment)* ~'[ \t]*' Docstring))?
Docstring <- DocPart (~'[ \t]*' DocPart)* &~'[ \t]*(?:[;#\r\n]|\Z)'
DocPart <- ~'[rRuU]?' Quoted
String <- ~'[A-Za-z]{0,2}' Quoted
Quoted <- ~'\x22\x22\x22(?:\\.|[^\\])*?\x22\x22\x22' / ~'\x27\x27\x27(?:\\.|[^\\])*?\x27\x27\x27'
       / ~'\x22(?:\\.|[^\x22\\\n])*\x22' / ~'\x27(?:\\.|[^\x27\\\n])*\x27'
"""

CPP = r"""
Chunk <- FileLine? Lead* Def
FileLine <- ~'// File:[^\n]*\n?'
Lead <- LineComment / BlockComment / Gap
Gap <- ~'[ \t\f\r]*\n'
LineComment <- ~'[ \t]*//[^\n]*(?:\n|\Z)'
BlockComment <- ~'[ \t]*/\*.*?\*/[ \t\r]*\n?'
Def <- Signature ~'[ \t\r\n]*' Body?
Signature <- (Group / ~'[^(){;]')+
Group <- '(' (Group / ~'[^()]')* ')'
Body <- '{'
"""


@functools.lru_cache(maxsize=2)
def grammar(language: str) -> Grammar:
    return Grammar(PYTHON if language == "python" else CPP)


class Pair(NamedTuple):
    doc: str
    doc_start: int
    doc_end: int
    def_start: int
    signature: str


def _directly_above(lead: list[Node], comments: tuple[str, ...]) -> list[Node]:
    """Comments with nothing but decorators and comments up to the definition."""
    kept: list[Node] = []
    for n in lead:
        kind = n.children[0]
        if kind.name == "Gap":
            kept = []
        elif kind.name in comments:
            kept.append(kind)
    return kept


def extract(content: str, language: str) -> Pair | None:
    """The pair of a chunk with offsets into ``content``; None if it is no function of that language."""
    tree = grammar(language).parse(content)
    if tree is None:
        return None
    definition = find(tree, "Def")[0]
    lead = [c for c in tree.children if c.name == "Lead"]
    above = _directly_above(lead, ("Comment",) if language == "python" else ("LineComment", "BlockComment"))
    parts = [(n.start, n.end, _comment_text(content[n.start : n.end], n.name)) for n in above]
    for n in find(definition, "Docstring"):
        text = "\n".join(_literal(content[p.start : p.end]) for p in find(n, "DocPart"))
        parts.append((n.start, n.end, text))
    signature = (find(definition, "Signature") or find(definition, "FirstLine"))[0]
    sig = content[signature.start : signature.end]
    if not parts:
        return Pair("", definition.start, definition.start, definition.start, sig)
    return Pair("\n".join(p[2] for p in parts), parts[0][0], parts[-1][1], definition.start, sig)


def _literal(source: str) -> str:
    try:
        return ast.literal_eval(source)
    except (SyntaxError, ValueError):
        return source.strip("rRuU\"'")


def _comment_text(source: str, kind: str) -> str:
    s = source.strip()
    if kind == "Comment":
        return s.lstrip("#").removeprefix("!")
    if kind == "LineComment":
        return re.sub(r"^//[/!]*<?", "", s)
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in re.sub(r"\**\*/$", "", re.sub(r"^/\*[*!]*<?", "", s)).split("\n"))


# Notes to tools, placeholders and filler words.
TOOL_NOTE = re.compile(
    r"^(?:noqa\b|type:\s*ignore|pylint:|pyright:|mypy:|flake8:|ruff:|isort:|fmt:\s*(?:on|off|skip)|yapf:|nosec\b|nosem|pragma:?\s|"
    r"nolint|clang-format\s|clang-tidy|cppcheck|cpplint|iwyu|eslint|lint:|coverage:|doctest:|-\*-|vim?:|ex:|codespell|spell-?check|@formatter|region\b|endregion\b|gcovr?|lcov|nopep8|autopep8|black:|sonar|spdx-|bandit|hadolint|shellcheck|coding[:=])",
    re.I,
)
PLACEHOLDER = re.compile(
    r"^\W*(?:to-?do|fix-?me|x{2,}|wip|tbd|tba|n/?a|none|null|nil|undocumented|no (?:docs?|documentation|description|comment)|not documented|doc(?:string|s|umentation)?|document(?: me| this)?|"
    r"(?:add |insert |missing )?(?:a )?(?:description|summary|docs?|documentation|docstring|comment)(?: here| goes here| missing| pending| needed)?|_?summary_?|_?description_?|_?type_?|placeholder|lorem ipsum.*|empty|dummy|stub|"
    r"(?:write|add|needs?|missing) (?:the |some )?(?:docs?|documentation|docstring|description)|work in progress|coming soon|see above|see below|ditto|same|self[- ]explanatory|obvious|"
    r"à compléter|a completar|por hacer|pendiente|à faire|zu erledigen|noch offen|fehlt|da fare|待补充|待定|未定|説明|未記入|заполнить|добавить описание)\W*$",
    re.I,
)
TODO_HEAD = re.compile(r"^\W*(?:to-?do|fix-?me|xxx|tbd|wip|hack)\b[\s:\-–—(]*", re.I)
SECTION = re.compile(r"^(?:args|arguments|param(?:eter)?s?|returns?|yields?|raises?|exceptions?|throws?|attributes|notes?|examples?|see also|other parameters|warns?|warnings?|keyword args|todo)\s*:?\s*$", re.I)
TAG = re.compile(r"^[:@\\](?:param(?:eter)?|arg(?:ument)?|tparam|keyword|type|key|var|ivar|cvar|raises?|throws?|exception|retval)(?:\s*\[[\w, ]*\])?(?:\s+\w+)*?\s+\*{0,2}(\w+)\s*:?|^[:@\\](?:returns?|rtype|brief|details?|short|note|see|since|yields?|sa|todo|deprecated|result|fn|file|author|date|version|ingroup|addtogroup|internal)\b:?", re.I)
FIELD = re.compile(r"^\*{0,2}(\w+)\s*(?:\([^)]*\))?\s*:\s*(?:list|dict|int|float|str|bool|bytes|tuple|set|object|any|none|optional|array(?:-like)?|callable|iterable|sequence|number)?\s*(?:,\s*optional)?\s*$", re.I)
FILLER = frozenset(
    "a an the this that these those it its is are was be been will would can could should may might shall must do does did to of for in on at by with from into as and or if "
    "function functions method methods routine procedure helper helpers utility util class member free static inline constructor destructor wrapper callable def "
    "returns return returned given some value values parameter parameters param params arg args argument arguments input inputs output outputs self cls void "
    "la le les un une des du de fonction méthode die der das ein eine funktion methode el los las una función método функция метод".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿가-힯]")
_CODE_LINE = re.compile(r"^(?:[\w.\[\]'\"]+\s*(?:[-+*/|&^]|<<|>>|//|\*\*)?=(?!=)\s*\S.*|[\w.:]+(?:->\w+)*\(.*\)\s*;?|.*[;{}]|(?:return|import|from|if|for|while|raise|del|assert|print|else|elif|try|except|with|break|continue|pass|yield|await|goto|delete|throw|#\s*\w+)\b.*[:;()=\[\]].*|(?:return|break|continue|pass)\b\s*\w*)$", re.S)


def _is_code(line: str, language: str) -> bool:
    if not _CODE_LINE.match(line):
        return False
    if language == "python":
        try:
            body = ast.parse(line.strip() + ("\n    pass" if line.rstrip().endswith(":") else "")).body
        except (SyntaxError, ValueError):
            return False
        return bool(body) and not (isinstance(body[0], ast.Expr) and isinstance(body[0].value, (ast.Name, ast.Constant, ast.Tuple)))
    return bool(re.search(r"[;{}]\s*$|\)\s*$|=", line))


def _stem(w: str) -> str:
    w = w.casefold()
    for end in ("ing", "ies", "es", "ed", "s", "er"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)].rstrip("e")
    return w.rstrip("e") if len(w) > 3 else w


def name_parts(text: str) -> set[str]:
    """Stems of the words inside the identifiers of ``text``."""
    out = set()
    for ident in re.findall(r"\w+", text):
        out.add(_stem(ident))
        for part in re.split(r"_+", ident):
            out.update(_stem(x) for x in re.findall(r"[A-Z]?[^\WA-Z\d_]+|[A-Z]+(?![^\WA-Z\d_])", part))
    return out


#: Words beyond the names that a description must have.
LEAST_WORDS = 2


def clean_doc(doc: str, language: str) -> str:
    """The describing text: without tool notes, ornaments, bare tags, disabled code and placeholders."""
    lines = []
    for raw in doc.split("\n"):
        line = raw.strip()
        if not line or TOOL_NOTE.match(line) or SECTION.match(line) or FIELD.match(line):
            continue
        if not re.search(r"[^\W_]", line) or PLACEHOLDER.match(line) or _is_code(line, language):
            continue
        if m := TAG.match(line):
            line = line[m.end() :].strip()
        line = TODO_HEAD.sub("", line)
        if line and not PLACEHOLDER.match(line) and re.search(r"[^\W_]", line):
            lines.append(line)
    return "\n".join(lines)


def is_informative(doc: str, symbol: str, signature: str, language: str) -> bool:
    """Whether ``doc`` tells more than the names of the function and of its parameters."""
    text = clean_doc(doc, language)
    if not text:
        return False
    if len(_UNSPACED.findall(text)) >= 4:
        return True
    known = name_parts(symbol + " " + signature)
    words = {w.casefold() for w in _WORD.findall(re.sub(r"^\w+(?:\s*\([^)]*\))?\s*:\s", "", text, flags=re.M))}
    fresh = {w for w in words if w not in FILLER and _stem(w) not in known and len(w) > 1}
    return len(fresh) >= LEAST_WORDS


def language_of(content: str, language: str | None) -> str:
    """By the header line; else by the declared language."""
    if content.startswith("# File:"):
        return "python"
    if content.startswith("// File:"):
        return "cpp"
    return "cpp" if (language or "").strip().lower() in ("cpp", "c++", "c") else "python"


PAIRS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("symbol_name", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("doc_start", T.IntegerType()),
        T.StructField("doc_end", T.IntegerType()),
        T.StructField("def_start", T.IntegerType()),
    ]
)


def documented_functions(chunks: DataFrame, with_text: bool = True) -> DataFrame:
    """Description-code pairs of the function and method chunks whose documentation is informative.

    Rows of one ``chunk_id`` with equal pairs come out once.  Null content, content that is no function of
    its language and null ids give no row; a null ``symbol_name`` counts as no name.  ``with_text=False``
    leaves description and code null, so that only ids are shuffled.
    """
    src = chunks.where(F.col("chunk_type").isin(*FUNCTION_TYPES) & F.col("chunk_id").isNotNull() & F.col("content").isNotNull())
    arrow = to_arrow_schema(PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lang = language_of(r["content"], r["language"])
                pair = extract(r["content"], lang)
                symbol = r["symbol_name"] or ""
                if pair is None or not pair.doc or not is_informative(pair.doc, symbol, pair.signature, lang):
                    continue
                row = {"chunk_id": r["chunk_id"], "symbol_name": symbol, "language": lang}
                if with_text:
                    row |= {"description": clean_doc(pair.doc, lang), "code": r["content"][pair.def_start :], "doc_start": pair.doc_start, "doc_end": pair.doc_end, "def_start": pair.def_start}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return spread(src.select("chunk_id", "symbol_name", "language", "content")).mapInArrow(run, PAIRS).distinct()
