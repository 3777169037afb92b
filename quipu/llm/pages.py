"""Main body of web pages kept as lines, without the page's other content.

A page's lines are read as a tree: the page, the region around its headline, the sections that short labels open, and
the lines.  Each line is a node with features of itself (length, punctuation, capitals, tokens), its siblings
(neighbours of the same kind, runs of them), its depth (section, distance to the headline) and its section's text
density.  Gradient-boosted trees score the nodes.  Decoding goes from the root down, so that no line is kept under a
section that isn't, nothing is kept on a page without an article of its own, and single doubtful lines follow what
stands around them.

There are no labelled pages: the trees learn from labelling rules on a sample of SAMPLE_PAGES pages, rules that speak of
some lines only and abstain on others.  All pages are then scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages whose lines the trees learn from, the first in hash order.
SAMPLE_PAGES = 1500
TREES, DEPTH = 20, 5
#: Pages whose lines are scored together.
PAGES_AT_ONCE = 200

# Words that open or make up what surrounds an article, in Spanish, Portuguese and English.
_TEASER = r"^(?:m[aá]s (?:en|de|sobre|noticias|le[ií]d)|[uú]ltimas|lo m[aá]s|lo [uú]ltimo|notas? relacionad|noticias relacionad|relacionad|recomendad|tambi[eé]n en|te puede interesar|le puede interesar|puede interesar|mira adem[aá]s|lea tambi[eé]n|lee tambi[eé]n|vea tambi[eé]n|leia tamb[eé]m|veja tamb[eé]m|mais lidas|related|read (?:also|more)|more (?:in|from|on)|most read|trending|en portada|no te pierdas|destacad)"
_END = r"^(?:comentarios?|coment[aá]rios|comments|deje su comentario|opiniones de lectores)\b.{0,20}$"
_NOISE = (
    r"(?:usamos|utiliza(?:mos)?|acept\w+|pol[ií]tica de|uso de) (?:las )?cookies|^cookies|consiente|^valoramos su privacidad|pol[ií]tica de privacidad$|preferencias en cualquier momento|derechos reservados\W*$|all rights reserved|copyright|©|^suscr[ií]b|^reciba |escriba su |para suscriptores$|newsletter|bolet[ií]n diario"
    r"|^publicidad$|^anuncio|despu[eé]s del anuncio|anuncie con|s[ií]gu[ae]nos|[uú]nase a|descargue? (?:la|nuestra) app|nuestro canal|^compart[aie]|copiar enlace|^imprimir|iniciar? sesi[oó]n|inicie sesi[oó]n|registr(?:arse|ese)|mi cuenta|^buscar$|^men[uú]$|☰|✕|↑"
    r"|^aceptar|^rechazar|^entendido|^configurar|mapa del sitio|volver arriba|qui[eé]nes somos|^contacto\b|t[eé]rminos y condiciones|desarrollado por|central telef[oó]nica|^calle |^av(?:enida|\.) |publicaci[oó]n independiente|no reflejan necesariamente|^(?:edici[oó]n impresa|clasificados|suplementos|multimedia|podcast|videos)$"
    r"|^visitas:|lectura de \d+ min|tiempo de lectura|p[aá]gina no encontrada|ya no existe|contenido exclusivo"
)
_CAPTION = r"^\W*(?:foto|fotograf[ií]a|imagen|imagen referencial|vista de|gr[aá]fico|video|galer[ií]a|cr[eé]dito|cortes[ií]a|photo|image)\b|\((?:foto|imagen|fotograf[ií]a)[^)]*\)\s*$|^\[.{0,40}\]$"
_BYLINE = r"^(?:por|by|escrito por|texto:?|autor:?)\s+\p{Lu}[^,.]*$|^\p{Lu}[^.,:|/]{2,40} / \p{Lu}[^.,:|/]{2,60}$|^redacci[oó]n\b|^(?:enviado especial|corresponsal)"
_TAGS = r"^(?:etiquetas|temas|tags|palabras clave|t[oó]picos|keywords)\s*:|^#\w"
_DATE = r"^(?:(?:lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo)?,?\s*\d{1,2}\s+(?:de\s+)?\p{L}+\.?(?:\s+(?:de\s+)?\d{4})?|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}-\d\d-\d\d)\b.{0,25}$|^(?:publicado|actualizado|fecha)\b.{0,50}$"
_SAYS = r"^\S+ (?:dice|escribi[oó]|coment[oó]|says|wrote):?$"
_CLOCK = r"^\d{1,2}[:.]\d{2}\s+\p{L}"

FEATURES = [
    "words", "chars", "sentences", "ends", "starts_upper", "upper_share", "digit_share", "bullet", "numbered", "clock", "bars", "marks", "colon", "comma_share", "title_like",
    "label", "is_head", "head_overlap", "after_head", "before_head", "from_end", "noise", "teaser_open", "comment_open", "caption", "byline", "tags", "date", "says", "tokens",
    "prev_words", "prev_sentences", "prev_title_like", "prev_label", "prev_noise", "next_words", "next_sentences", "next_title_like", "next_label", "next_noise",
    "in_teaser", "in_comments", "place_in_section", "density", "same_before", "same_after", "has_head",
]


def _compile() -> dict[str, object]:
    import regex

    return {k: regex.compile(v, regex.I if k not in ("byline", "clock") else 0) for k, v in {
        "teaser": _TEASER, "end": _END, "noise": _NOISE, "caption": _CAPTION, "tags": _TAGS, "date": _DATE, "says": _SAYS,
        "byline": _BYLINE.replace("por|by", "[Pp]or|[Bb]y").replace("^redacci", "^[Rr]edacci"), "clock": _CLOCK}.items()}


_RULES: dict[str, object] = {}


class _Folds(dict):
    """Character to its base letter or digit in lower case, or a space."""

    def __missing__(self, code: int) -> str:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        self[code] = out = "" if unicodedata.combining(chr(code)) else "".join(c if c.isascii() and c.isalnum() else " " for c in base)
        return out


_FOLDS = _Folds()
_UPPER, _LETTER, _DIGIT, _MARKS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"[©@#☰✕↑\[\]]")


def _fold(text: str) -> str:
    return " ".join(text.translate(_FOLDS).split())


class Line:
    """A node of the page: what is known of one line before it is scored."""

    __slots__ = ("number", "text", "folded", "words", "sentences", "ends", "title_like", "label", "kind", "section", "place", "block")

    def __init__(self, number: int, text: str):
        rules = _RULES or _RULES.update(_compile()) or _RULES
        self.number, self.text, self.folded = number, text, _fold(text)
        body = re.sub(r"^(?:[-•*·–]|\d{1,2}[.)])\s+", "", text)
        self.words = len(body.split())
        self.ends = bool(re.search(r"[.!?…][\"'”»)]*$", text))
        self.sentences = len(re.findall(r"[.!?][\"'”»)]*(?=\s+[\"'“«(¿¡]?[A-ZÁÉÍÓÚÑ0-9]|$)", text))
        self.title_like = not self.ends and self.words >= 6 and "|" not in text and ">" not in text
        self.label = not self.ends and self.words <= 6
        r = rules
        self.kind = (
            "says" if r["says"].search(text) else "end" if r["end"].search(text) else "teaser" if r["teaser"].search(text) else
            "noise" if r["noise"].search(text) or text.count("|") >= 2 or text.count("·") >= 2 or re.search(r"^\S.* > ", text) else
            "caption" if r["caption"].search(text) else "tags" if r["tags"].search(text) else "date" if self.words <= 9 and r["date"].search(text) else
            "byline" if self.words <= 12 and r["byline"].search(text) else ""
        )
        self.section, self.place, self.block = "", 0, 0


def headline(lines: list[Line], title: str | None, url: str | None) -> int:
    """Place of the page's own headline: the line that is the title, or that the address spells; -1 if there is none.

    Where there is neither a title nor an address that spells one: the first line like a headline that paragraphs follow.
    """
    want = _fold(title or "")
    path = re.sub(r"[?#].*$", "", url or "").rstrip("/").rpartition("/")[2]
    slug = re.sub(r"(?:[-_]?\d+)?(?:\.\w+)?$", "", path).replace("_", "-").lower()
    for i, x in enumerate(lines):
        if want and len(want) > 8 and x.folded == want:
            return i
    if slug.count("-") >= 2:
        for i, x in enumerate(lines):
            own = x.folded.replace(" ", "-")
            if x.kind == "" and x.words >= 4 and (own == slug or own.startswith(slug + "-")):
                return i
    elif not want:
        for i, x in enumerate(lines):
            if x.kind == "teaser":
                break
            below = [y for y in lines[i + 1 : i + 9] if y.kind == "" and y.ends]
            if x.title_like and x.kind == "" and len(below) >= 2 and any(y.sentences > 1 for y in below):
                return i
    return -1


def tree(text: str, title: str | None, url: str | None) -> tuple[list[Line], int]:
    """The page's non-empty lines with their sections, and the place of its headline."""
    lines = [Line(n, t) for n, t in ((n, t.strip()) for n, t in enumerate(text.split("\n"), 1)) if t]
    head = headline(lines, title, url)
    section, place, block, open_lead, items, leads = "", 0, 0, False, 0, 0
    for i, x in enumerate(lines):
        if i == head:
            section, place, block = "article", 0, block + 1
        elif x.kind == "teaser":
            inline = x.words > 7  # a teaser that carries its headline in the same line opens nothing
            if not inline:
                section, place, block = "teaser", 0, block + 1
                open_lead, items, leads = False, 0, 0
        elif x.kind == "end":
            section, place, block = "comments", 0, block + 1
        elif section == "teaser":
            item = x.title_like and not x.kind
            # teasers of one section have all a lead or none
            lead = open_lead and x.ends and x.sentences == 1 and leads == items - 1
            items, leads = items + item, leads + lead
            if not (item or lead) or x.kind:
                section, place, block = ("article" if 0 <= head < i else ""), 0, block + 1
            open_lead = item
        place += 1
        x.section, x.place, x.block = section, place, block
    return lines, head


def features(lines: list[Line], head: int, odds: dict[str, float]) -> np.ndarray:
    """One row per line, columns as in FEATURES."""
    n = len(lines)
    out = np.zeros((n, len(FEATURES)), "float32")
    head_words = set(lines[head].folded.split()) if head >= 0 else set()
    dense: dict[int, list[int]] = {}
    for x in lines:
        dense.setdefault(x.block, []).append(len(x.text))
    means = {b: sum(v) / len(v) for b, v in dense.items()}
    kind = ["p" if x.sentences > 1 else "s" if x.ends else "t" if x.title_like else "l" for x in lines]
    before = [0] * n
    after = [0] * n
    for i in range(1, n):
        before[i] = before[i - 1] + 1 if kind[i] == kind[i - 1] else 0
    for i in range(n - 2, -1, -1):
        after[i] = after[i + 1] + 1 if kind[i] == kind[i + 1] else 0
    near = lambda x: (min(x.words, 80), min(x.sentences, 6), x.title_like, x.label, x.kind in ("noise", "says")) if x else (0, 0, 0, 0, 1)
    for i, x in enumerate(lines):
        t = x.text
        folded = x.folded.split()
        out[i] = (
            min(x.words, 80), min(len(t), 600), min(x.sentences, 6), x.ends, t[:1].isupper(), len(_UPPER.findall(t)) / max(1, len(_LETTER.findall(t))), len(_DIGIT.findall(t)) / len(t),
            bool(re.match(r"[-•*·–]\s", t)), bool(re.match(r"\d{1,2}[.)]\s", t)), bool(_RULES["clock"].match(t)), min(t.count("|") + t.count("·") + t.count(" > "), 9), len(_MARKS.findall(t)), ":" in t, t.count(",") / max(1, x.words), x.title_like,
            x.label, i == head, len(head_words & set(folded)) / max(1, len(set(folded))), min(max(0, i - head), 60) if head >= 0 else -1, max(0, head - i) if head >= 0 else -1, min(n - 1 - i, 60), x.kind == "noise", x.kind == "teaser", x.kind == "end", x.kind == "caption", x.kind == "byline", x.kind == "tags", x.kind == "date", x.kind == "says",
            sum(odds.get(w, 0.0) for w in folded) / max(1, len(folded)), *near(lines[i - 1] if i else None), *near(lines[i + 1] if i + 1 < n else None),
            x.section == "teaser", x.section == "comments", min(x.place, 30), means[x.block], min(before[i], 12), min(after[i], 12), head >= 0,
        )
    return out


def weak_label(lines: list[Line], head: int, i: int) -> int | None:
    """1 main body, 0 not, None where no rule speaks."""
    x = lines[i]
    if head < 0 or i < head or x.kind or x.section in ("teaser", "comments") or _RULES["clock"].match(x.text):
        return 0
    if i == head or x.sentences > 1:
        return 1
    if re.match(r"[-•*·–]\s", x.text) and x.section == "article":
        return 1
    if x.ends and x.words >= 6:
        return 1
    if x.label and i + 1 < len(lines) and lines[i + 1].ends and not lines[i + 1].kind and x.section == "article":
        return 1
    return None


def _logit(trees: list[tuple[list, float]], x: np.ndarray) -> np.ndarray:
    """Score of boosted trees; each is (nodes, weight), a node (feature, threshold, left, right, value)."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for nodes, weight in trees:
        feature, limit, left, right, value = (np.array(c) for c in zip(*nodes))
        at = np.zeros(len(x), int)
        for _ in range(DEPTH + 1):
            f = feature[at]
            go = x[rows, np.maximum(f, 0)] <= limit[at]
            at = np.where(f >= 0, np.where(go, left[at], right[at]), at)
        total += weight * value[at]
    return total


def decode(lines: list[Line], head: int, score: np.ndarray) -> np.ndarray:
    """Which lines are kept, from the page down: page, region, section, line."""
    keep = np.zeros(len(lines), bool)
    if head < 0:
        return keep
    ended = next((i for i, x in enumerate(lines) if i > head and x.kind == "end"), len(lines))
    for i, x in enumerate(lines):
        if head <= i < ended and x.section == "article":
            keep[i] = score[i] > 0
    keep[head] = True
    # a subheading needs a kept line below it, before the next label of its kind
    for i in range(len(lines) - 1, head, -1):
        x = lines[i]
        if keep[i] and x.label and not re.match(r"[-•*·–]\s", x.text) and ":" not in x.text and not (i + 1 < len(lines) and keep[i + 1 : i + 4].any()):
            keep[i] = False
    return keep


class Model:
    """Trees and token odds learned from a sample of pages."""

    def __init__(self, pages: DataFrame):
        sample = pages.where("texto is not null").orderBy(F.xxhash64("page_id")).limit(SAMPLE_PAGES)
        rows = [(r["texto"], r["titulo"], r["url"]) for r in sample.select("texto", "titulo", "url").collect()]
        told: list[tuple[list[Line], int, list[int | None]]] = []
        counts = (Counter(), Counter())
        for text, title, url in rows:
            lines, head = tree(text, title, url)
            labels = [weak_label(lines, head, i) for i in range(len(lines))]
            told.append((lines, head, labels))
            for x, y in zip(lines, labels):
                if y is not None:
                    counts[y].update(set(x.folded.split()))
        sums = [sum(c.values()) + 1 for c in counts]
        self.odds = {w: log((counts[1][w] + 1) / sums[1]) - log((counts[0][w] + 1) / sums[0]) for w in set(counts[0]) | set(counts[1]) if counts[0][w] + counts[1][w] >= 3}
        data = []
        for lines, head, labels in told:
            if lines:
                for y, f in zip(labels, features(lines, head, self.odds)):
                    if y is not None:
                        data.append((float(y), f.tolist()))
        self.trees: list[tuple[list, float]] = []
        if len({y for y, _ in data}) == 2:
            table = pages.sparkSession.createDataFrame(pd.DataFrame(data, columns=["label", "f"]), "label double, f array<double>")
            found = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=5, stepSize=0.2).fit(table.select("label", array_to_vector("f").alias("features")))
            for k, t in enumerate(found.trees):
                self.trees.append((self._nodes(t._java_obj.rootNode()), found.treeWeights[k]))

    def _nodes(self, root) -> list:
        nodes: list = []

        def walk(node) -> int:
            at = len(nodes)
            nodes.append(None)
            if node.getClass().getSimpleName() == "LeafNode":
                nodes[at] = (-1, 0.0, 0, 0, node.prediction())
            else:
                s = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                nodes[at] = (s.featureIndex(), s.threshold(), left, right, 0.0)
            return at

        walk(root)
        return nodes

    def kept(self, pages: list[tuple[str, str | None, str | None]]) -> Iterator[tuple[list[Line], np.ndarray]]:
        """Lines of each page (text, title, url), and which are its main body; the pages' lines are scored together."""
        read = [tree(*p) for p in pages]
        rows = [features(lines, head, self.odds) for lines, head in read]
        score = _logit(self.trees, np.concatenate(rows)) if rows and self.trees else np.full(sum(map(len, rows)), -1.0)
        at = 0
        for lines, head in read:
            own = score[at : at + len(lines)]
            at += len(lines)
            yield lines, decode(lines, head, own) if self.trees else np.zeros(len(lines), bool)


def _scan(pages: DataFrame, columns: str, row) -> DataFrame:
    model = Model(pages)
    shared = pages.sparkSession.sparkContext.broadcast((model.trees, model.odds))

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model.__new__(Model)
        own.trees, own.odds = shared.value
        for part in parts:
            for i in range(0, len(part), PAGES_AT_ONCE):
                some = part.iloc[i : i + PAGES_AT_ONCE]
                rows = []
                for page, (lines, keep) in zip(some["page_id"], own.kept(list(zip(some["texto"], some["titulo"], some["url"])))):
                    rows += row(page, lines, keep)
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in columns.split(", ")])

    return pages.where("page_id is not null and texto is not null").select("page_id", "texto", "titulo", "url").mapInPandas(each, columns)


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """``(page_id, linea)``: number, from 1, of each non-empty line outside the main body.

    A page without an article has none inside; null and empty texts have no lines.  Repeated pages count once.
    """
    row = lambda page, lines, keep: [(page, x.number) for x, k in zip(lines, keep) if not k]
    return _scan(pages, "page_id bigint, linea int", row).distinct()


def main_bodies(pages: DataFrame) -> DataFrame:
    """``(page_id, body)``: the main body's lines in order; empty if there is no article."""
    row = lambda page, lines, keep: [(page, "\n".join(x.text for x, k in zip(lines, keep) if k))]
    return _scan(pages, "page_id bigint, body string", row).distinct()
