"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks.  Each block is a vector: its path of elements (tags, and
the parts of their class, id and role names) hashed, its words hashed, and its shape.  A bidirectional
LSTM reads the whole sequence, so that every block is labelled with the context of the whole page;
blocks of the article are joined in page order.

The labeller is trained here: on pages of the layouts in ``FAMILIES`` that are built from a fixed seed,
once in a driver, and then for a few rounds more on ``SAMPLE`` pages of the table at most (chosen by a
hash, of at most ``LARGEST`` characters each) whose elements say what they hold: blocks in ``article`` or
``main`` and in no element of ``CLUTTER``; an article's own header holds its headline.
All pages are read whole.

Cases: null and empty pages, and those without article, have the empty text; unclosed and stray tags
are read as browsers do; repeated rows give repeated results, and pages that share an id a row each; an
empty table gives an empty result; other columns are not read; memory follows the longest page.
"""

from __future__ import annotations

import copy
import functools
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.llm import common
from cuboid.llm.html_blocks import Block, blocks

SAMPLE, LARGEST = 160, 1 << 16
BUILT, HIDDEN, EPOCHS, RATE, SEED = 5000, 24, 8, 0.02, 11
#: Built pages and rounds with which a table's own pages are learned.
BESIDE, MORE_EPOCHS, MORE_RATE = 160, 3, 0.004
PATHS, WORDS, SHAPE, KINDS = 160, 24, 10, 8
DIM = 2 * PATHS + WORDS + SHAPE + KINDS
#: Elements, and names of elements, that hold no article text.
CLUTTER = frozenset(
    "nav header footer aside form menu ad ads advert advertisement sponsored promo banner cookie consent notice sidebar comment comments disqus related share social newsletter subscribe breadcrumb breadcrumbs pagination popup modal widget".split()
)

# --- vectors ---------------------------------------------------------------------------------------


class Vectors:
    """Block vectors; those of paths and words are kept in bounded tables."""

    def __init__(self) -> None:
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _path(self, path: tuple) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            found = np.zeros(2 * PATHS, np.float32)
            for depth, (tag, names) in enumerate(reversed(path)):
                # The element itself apart from those around it.
                low = 0 if depth == 0 else PATHS
                for token in ("<" + tag, *names):
                    h = zlib.crc32(token.encode("utf-8", "replace"))
                    found[low + h % PATHS] += 1.0 if h >> 16 & 1 else -1.0
            np.clip(found, -3, 3, out=found)
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = found
        return found

    def of(self, sequence: list[Block]) -> np.ndarray:
        out = np.zeros((len(sequence), DIM), np.float32)
        total = sum(len(b.text) for b in sequence) + 1
        done = 0
        table = self.words
        for i, b in enumerate(sequence):
            row, n = out[i], len(b.text)
            row[: 2 * PATHS] = self._path(b.path)
            listed = b.text.lower().split()
            for w in listed:
                h = table.get(w)
                if h is None:
                    if len(table) > 100_000:
                        table.clear()
                    h = table[w] = zlib.crc32(w.encode("utf-8", "replace")) % WORDS
                row[2 * PATHS + h] += 1
            row[2 * PATHS : 2 * PATHS + WORDS] /= len(listed) + 4
            for w in listed[:200] if len(listed) < 60 else ():
                for kind in _KIND_OF.get(w.strip(".,:;!?()|"), ()):
                    row[DIM - KINDS + kind] += 1
            row[DIM - KINDS :] /= len(listed) + 2
            marks = b.text.count(".") + b.text.count(",")
            row[2 * PATHS + WORDS : DIM - KINDS] = (
                np.log1p(n) / 5, b.linked / n, marks / (len(listed) + 1), min(marks, 5) / 5, len(listed) / (len(listed) + 10),
                n / total, done / total, i / len(sequence), i == 0, b.text[-1] in ".?!",
            )
            done += n
        return out


# --- network ---------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one in each direction, and a logistic output over both states and the block itself."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN) -> None:
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.p |= {f"x{d}": draw(DIM, 4 * h), f"h{d}": draw(h, 4 * h), f"b{d}": bias}
        self.p |= {"o": draw(2 * h + DIM, 1), "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of both directions, (t, n, 2h); the backward one reads the sequence from its end, beside the forward one."""
        t, n, _ = x.shape
        h = self.h
        flat = x.reshape(t * n, -1)
        z = np.stack([(flat @ self.p[f"x{d}"] + self.p[f"b{d}"]).reshape(t, n, 4 * h)[:: 1 if d == "f" else -1] for d in "fb"], axis=1)
        masks = np.stack([mask, mask[::-1]], axis=1)[..., None]
        across = np.stack([self.p["hf"], self.p["hb"]])
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out, saved = np.zeros((t, 2, n, h), np.float32), []
        for i in range(t):
            g = z[i] + state @ across
            gates, new = _sigmoid(g[..., : 3 * h]), np.tanh(g[..., 3 * h :])
            m = masks[i]
            c = gates[..., h : 2 * h] * cell + gates[..., :h] * new
            c = np.where(m, c, cell)
            tc = np.tanh(c)
            s = np.where(m, gates[..., 2 * h :] * tc, state)
            if keep:
                saved.append((gates, new, cell, tc, state, m))
            state, cell = s, c
            out[i] = s
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2), saved

    def _back(self, x: np.ndarray, saved: list, given: np.ndarray, grads: dict) -> None:
        t, n, _ = x.shape
        h = self.h
        given = np.stack([given[..., :h], given[::-1, :, h:]], axis=1)
        across = np.stack([self.p["hf"].T, self.p["hb"].T])
        dz, total = np.zeros((t, 2, n, 4 * h), np.float32), np.zeros((2, h, 4 * h), np.float32)
        ds, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for i in range(t - 1, -1, -1):
            gates, new, before, tc, state, m = saved[i]
            ds = ds + given[i]
            here = np.where(m, ds, 0)
            gi, gf, go = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            cell = np.where(m, dc + here * go * (1 - tc * tc), 0)
            part = dz[i]
            part[..., :h] = cell * new * gi * (1 - gi)
            part[..., h : 2 * h] = cell * before * gf * (1 - gf)
            part[..., 2 * h : 3 * h] = here * tc * go * (1 - go)
            part[..., 3 * h :] = cell * gi * (1 - new * new)
            total += state.transpose(0, 2, 1) @ part
            ds = np.where(m, part @ across, ds)
            dc = np.where(m, cell * gf, dc)
        flat = x.reshape(t * n, -1).T
        for k, d in enumerate("fb"):
            own = np.ascontiguousarray(dz[:: 1 if d == "f" else -1, k]).reshape(t * n, -1)
            grads[f"h{d}"] += total[k]
            grads[f"x{d}"] += flat @ own
            grads[f"b{d}"] += own.sum(axis=0)

    def _pad(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(len(p) for p in pages)
        x, mask = np.zeros((t, len(pages), DIM), np.float32), np.zeros((t, len(pages)), bool)
        for j, p in enumerate(pages):
            x[: len(p), j], mask[: len(p), j] = p, True
        return x, mask

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE, batch: int = 48) -> None:
        rng, moments, step = np.random.default_rng(SEED), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}, 0
        total = epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            by_length = sorted(range(len(pages)), key=lambda i: (len(pages[i]) // 8, rng.random()))
            groups = [by_length[i : i + batch] for i in range(0, len(pages), batch)]
            for k in rng.permutation(len(groups)):
                x, mask = self._pad([pages[i] for i in groups[k]])
                y = self._pad_labels([labels[i] for i in groups[k]], len(x))
                states, saved = self._run(x, mask, True)
                both = np.concatenate([states, x], axis=2)
                prob = _sigmoid((both @ self.p["o"])[:, :, 0] + self.p["c"])
                err = np.where(mask, prob - y, 0).astype(np.float32) / mask.sum()
                grads = {n: np.zeros_like(v) for n, v in self.p.items()}
                grads["o"] += both.reshape(-1, both.shape[2]).T @ err.reshape(-1, 1)
                grads["c"] += err.sum()
                self._back(x, saved, err[:, :, None] * self.p["o"][: 2 * self.h, 0], grads)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                now = rate * min(1.0, 5.0 / (norm + 1e-9)) * (1 - 0.9 * step / total)
                for n, g in grads.items():
                    a, b = moments[n]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[n] -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _pad_labels(labels: list[np.ndarray], t: int) -> np.ndarray:
        y = np.zeros((t, len(labels)), np.float32)
        for j, p in enumerate(labels):
            y[: len(p), j] = p
        return y

    def predict(self, pages: list[np.ndarray], rows: int = 1 << 14) -> list[np.ndarray]:
        """Probability of each block of each page to be of the article; pages of like length run together, a long one in bounded memory by itself."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= rows and len(pages[order[end]]) <= 2 * len(pages[order[at]]) + 8:
                end += 1
            x, mask = self._pad([pages[i] for i in order[at:end]])
            both = np.concatenate([self._run(x, mask, False)[0], x], axis=2)
            prob = _sigmoid((both @ self.p["o"])[:, :, 0] + self.p["c"])
            for j, i in enumerate(order[at:end]):
                out[i] = prob[: len(pages[i]), j]
            at = end
        return out


# --- training pages --------------------------------------------------------------------------------

_SYLLABLES = "the and er en on re an tion ing le de la os es ie ch ung ar st th ou eux ment que ci ado".split()
_SAID = {
    "cookie": "we use cookies accept all settings privacy policy cookies akzeptieren acepte las cookies nous utilisons des cookies",
    "comment": "reply says comment posted ago likes report kommentar antworten responder commentaire",
    "ad": "advertisement sponsored buy now sale offer anzeige publicidad publicite promoted",
    "share": "share tweet like facebook twitter email print teilen compartir partager",
    "form": "name email message send search submit login password subscribe newsletter senden buscar",
    "foot": "copyright all rights reserved terms privacy contact imprint about impressum aviso legal mentions",
    "nav": "home news sports about contact login menu products blog startseite inicio accueil archive",
    "side": "related popular recent posts most read see also tags categories trending",
}


_KIND_OF: dict[str, list[int]] = {}
for _kind, _line in enumerate(_SAID.values()):
    for _w in _line.split():
        _KIND_OF.setdefault(_w, []).append(_kind)
_KIND_OF |= {"\u00a9": [5], "(c)": [5]}

#: Layouts: of semantic elements and telling names, of tables, with names that say nothing, of bare elements, and by roles.
FAMILIES = ("usual", "tables", "unnamed", "bare", "roles")


def _layouts(seed: int, count: int, families: tuple[str, ...] = FAMILIES) -> Iterator[str]:
    """Pages; the mark \\x02 before a block's text says that it is of the article."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        out = []
        while sum(map(len, out)) < rng.randint(low, high) or not out:
            s = " ".join(word() for _ in range(rng.randint(1, 14)))
            out.append(s.capitalize() + rng.choice((".", ".", ".", ",", "!", "?")))
        return " ".join(out)

    def said(kind: str, n: int) -> str:
        pool = _SAID[kind].split() if rng.random() < 0.5 else None
        return " ".join(rng.choice(pool) if pool else word() for _ in range(n))

    def names(*options: str) -> str:
        x = rng.choice(options)
        if rng.random() < 0.3:
            x = rng.choice((f"{x} {word()}", f"{word()}-{x}", f"{x}-{word()}", f"{x} c{rng.randint(1, 99)}"))
        return f' {rng.choice(("class", "class", "id"))}="{x}"'

    def links(kind: str, n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{said(kind, rng.randint(1, 3))}</a></li>' for _ in range(n))

    def article() -> list[str]:
        out = []
        if rng.random() < 0.85:
            out.append(f"<h1>\x02{prose(5, 60).rstrip('.,!?')}</h1>")
        for _ in range(rng.choice((1, 2, 3, 4, 6, 10, 18))):
            r = rng.random()
            body = prose(1, rng.choice((3, 30, 120, 500, 1200)))
            if r < 0.1:
                out.append(f"<p>\x02<b>{body}<br>{prose(5, 80)}")
            elif r < 0.16:
                out.append(f"<h{rng.randint(2, 4)}>\x02{word()} {word()}</h2>")
            elif r < 0.22:
                out.append("<ul>" + "".join(f"<li>\x02{prose(5, 60)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.26:
                out.append(f"<blockquote><p>\x02{body}</p></blockquote>")
            elif r < 0.29:
                out.append(f"<pre><code>\x02{body}</code></pre>")
            elif r < 0.32:
                out.append("<table>" + "".join(f"<tr><td>\x02{word()}</td><td>\x02{word()} {rng.randint(1, 99)}</td></tr>" for _ in range(2)) + "</table>")
            elif r < 0.38:
                out.append(f"<div>\x02{body}</div>")
            elif r < 0.45:
                out.append(f'<p>\x02{body} <a href="/{word()}">{word()}</a> {prose(5, 60)}</p>')
            else:
                out.append(f"<p>\x02{body}</p>")
        return out

    def clutter(kind: str) -> str:
        if kind == "ad":
            tag = rng.choice(("div", "div", "aside", "section", "ins"))
            body = prose(5, 150) if rng.random() < 0.6 else said("ad", rng.randint(2, 12))
            inner = body if rng.random() < 0.6 else f"<p>{body}</p>"
            return f"<{'div' if tag == 'ins' else tag}{names('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'banner-ad')}>{inner}</{'div' if tag == 'ins' else tag}>"
        if kind == "cookie":
            return f"<div{names('cookie', 'cookie-banner', 'consent', 'notice', 'gdpr', 'cookie-notice', 'alert', 'popup', 'modal', 'site-notice')}><p>{said('cookie', rng.randint(5, 15)) if rng.random() < 0.6 else prose(10, 120)}</p><button>{said('cookie', 1)}</button></div>"
        if kind == "notice":
            tag = rng.choice(("div", "div", "p", "section", "aside"))
            body = prose(8, 120) if rng.random() < 0.7 else said("cookie", rng.randint(3, 9))
            return f"<{tag}{names('notice', 'alert', 'info-message', 'warning', 'site-notice', 'notification', 'announcement', 'update-notice', 'infobox-notice', 'disclaimer')}>{body if rng.random() < 0.5 or tag == 'p' else f'<p>{body}</p>'}</{tag}>"
        if kind == "share":
            return f"<div{names('share', 'social', 'sharing', 'share-buttons')}><ul>{links('share', 3)}</ul></div>"
        if kind == "form":
            return f"<form action=\"/s\"{names('search', 'newsletter', 'subscribe', 'contact', 'login') if rng.random() < 0.6 else ''}><{rng.choice(('label', 'p', 'div'))}>{said('form', rng.randint(1, 6)) if rng.random() < 0.6 else prose(5, 80)}</p><input type=text><select><option>{word()}<option>{word()}</select><button>{said('form', 1)}</button></form>"
        if kind == "comments":
            each = rng.choice(("<li><p>{}</p></li>", '<div class="comment"><p>{}</p></div>', '<div class="comment-body">{}</div>', "<li><b>{w}</b> {}</li>", "<article><p>{}</p></article>", '<article class="comment"><p>{}</p></article>', '<div class="reply"><span>{w}</span><p>{}</p></div>', "<p>{}</p>"))
            body = "".join(each.format(prose(5, 200) if rng.random() < 0.8 else said("comment", 6), w=word()) for _ in range(rng.randint(1, 6)))
            head = f"<h{rng.randint(2, 4)}>{said('comment', 2)}</h3>" if rng.random() < 0.6 else ""
            tag = rng.choice(("section", "div", "ol", "ul"))
            return f"<{tag}{names('comments', 'comment-list', 'commentlist', 'reader-comments', 'user-comments', 'disqus', 'responses', 'discussion')}>{head}{body}</{tag}>"
        if kind == "side":
            inner = f"<h3>{said('side', 2)}</h3><ul>{links('side', rng.randint(2, 6))}</ul>" if rng.random() < 0.6 else f"<h3>{said('side', 2)}</h3><p>{prose(10, 200)}</p>"
            return f"<aside{names('sidebar', 'side', 'related', 'widget') if rng.random() < 0.6 else ''}>{inner}</aside>" if rng.random() < 0.5 else f"<div{names('sidebar', 'side', 'related', 'widget', 'rail', 'related-posts', 'recommended', 'secondary')}>{inner}</div>"
        if kind == "nav":
            return f"<nav{names('nav', 'menu', 'main-nav') if rng.random() < 0.5 else ''}><ul>{links('nav', rng.randint(2, 8))}</ul></nav>" if rng.random() < 0.6 else f"<div{names('nav', 'menu', 'navbar', 'navigation', 'breadcrumbs', 'breadcrumb', 'topbar', 'pagination')}>{'<ul>' + links('nav', rng.randint(2, 8)) + '</ul>' if rng.random() < 0.6 else said('nav', 3)}</div>"
        if kind == "head":
            inner = rng.choice((f"<h1>{word()}</h1>", f"<div class=\"logo\">{word()}</div>", f"<p>{prose(5, 80)}</p>")) + (f"<ul>{links('nav', 3)}</ul>" if rng.random() < 0.5 else "")
            return f"<header{names('header', 'site-header', 'masthead') if rng.random() < 0.5 else ''}>{inner}</header>" if rng.random() < 0.6 else f"<div{names('header', 'site-header', 'masthead', 'top', 'branding')}>{inner}</div>"
        inner = rng.choice((f"&copy; {word()}.com &middot; {prose(5, 150)}", f"<p>{said('foot', 6)}</p>", f"<ul>{links('foot', 4)}</ul>", f"<p>{prose(5, 150)}</p>"))
        return f"<footer{names('footer', 'site-footer') if rng.random() < 0.4 else ''}>{inner}</footer>" if rng.random() < 0.6 else f"<div{names('footer', 'site-footer', 'bottom', 'legal', 'colophon', 'copyright')}>{inner}</div>"

    def told(kind: str) -> str:
        """Clutter in the words that it has, or in prose, without telling elements or names."""
        if kind in ("nav", "share"):
            tag = rng.choice(("p", "div", "ul", "div"))
            names_ = [f'<a href="/{word()}">{said(kind, rng.randint(1, 2))}</a>' for _ in range(rng.randint(2, 8))]
            return f"<ul>{''.join(f'<li>{x}</li>' for x in names_)}</ul>" if tag == "ul" else f"<{tag}>{rng.choice((' | ', ' ', '<br>', ' - ')).join(names_)}</{tag}>"
        if kind == "head":
            return rng.choice((f"<div>{word()}</div>", f"<h1>{word()}</h1>" if rng.random() < 0.3 else f"<p><a href='/'>{word()}</a></p>", f"<div>{word()} {word()}</div>"))
        if kind == "foot":
            year = rng.randint(1999, 2026)
            line = rng.choice(("&copy; {y} {w}. All rights reserved.", "Copyright {y} {w}", "Copyright {y} {w} {w}. All rights reserved.", "Copyright {y}. All rights reserved.", "(c) {y} {w} - all rights reserved - <a href=/p>privacy</a>", "{w} {y}. Terms and privacy", "Alle Rechte vorbehalten. Impressum {w}", "Tous droits reserves {w} {y}", "All rights reserved."))
            line = line.format(y=year, w=word())
            return rng.choice((f"<p>{line}</p>", f"<div>{line}</div>", f"<small>{line}</small>", line))
        if kind == "comments":
            n = rng.randint(1, 4)
            each = [f"<div>{rng.choice(('<b>{}</b> says:', '<p>{}</p>', 'Posted by {}', '{} wrote 3 days ago', 'Reply by {}')).format(word())} <p>{prose(5, 120)}</p>{rng.choice(('', '<a href=#>Reply</a>'))}</div>" for _ in range(n)]
            return f"<div>{rng.choice(('<h3>Comments</h3>', '<h3>{n} comments</h3>', '<p>Reader comments</p>', '<h4>Kommentare</h4>', '<h3>Comentarios</h3>', '<h3>Responses</h3>')).replace('{n}', str(n))}{''.join(each)}</div>"
        if kind == "side":
            return f"<div><h3>{said('side', 2) if rng.random() < 0.8 else word()}</h3><ul>{links('side', rng.randint(2, 6))}</ul></div>"
        if kind == "form":
            return f"<form action='/s'><p>{said('form', rng.randint(2, 6))}</p><input><button>{said('form', 1)}</button></form>"
        if kind in ("cookie", "notice"):
            return f"<div><p>{rng.choice(('We use cookies to improve this site.', 'This site uses cookies.', 'Diese Seite verwendet Cookies.', 'Ce site utilise des cookies.', said('cookie', 8)))}</p><button>{said('cookie', 1)}</button></div>"
        return f"<div>{rng.choice(('Advertisement', 'Sponsored', 'Anzeige', 'Publicidad'))}<p>{said('ad', rng.randint(3, 12)) if rng.random() < 0.6 else prose(5, 60)}</p></div>"

    def random_names(page: str) -> str:
        """Every class and id of a page becomes one that says nothing; semantic elements become plain ones, mostly."""
        out = []
        for i, piece in enumerate(page.split("<")):
            if i and " class=" in piece.split(">")[0] or i and " id=" in piece.split(">")[0]:
                tag, rest = piece.split(">", 1)
                piece = f'{tag.split()[0]} class="{rng.choice(("css-", "sc-", "x", "jss", "_"))}{rng.randrange(1 << 20):x}">{rest}'
            out.append(piece)
        return "<".join(out)

    def page(family: str) -> str:
        make = clutter if family in ("usual", "roles") else told
        before = [make(k) for k in ("head", "nav", "cookie", "ad", "form", "share", "side", "notice") if rng.random() < (0.75 if k == "nav" else 0.35)]
        after = [make(k) for k in ("ad", "share", "comments", "side", "form", "cookie", "nav") if rng.random() < 0.35] + [make("foot")] * (rng.random() < 0.85)
        rng.shuffle(before)
        inside = article()
        if family in ("usual", "roles") and rng.random() < 0.25 and inside[0].startswith("<h1>"):
            inside[0] = f"<header{names('entry-header', 'post-header', 'article-header') if rng.random() < 0.4 else ''}>{inside[0]}</header>"
        for kind in ("ad", "cookie", "notice", "share", "side", "form", "comments", "nav"):
            if rng.random() < (0.25 if kind == "comments" else 0.15):
                # Comments stand behind the article's text, other clutter anywhere in it.
                inside.insert(len(inside) if kind == "comments" else rng.randint(0, len(inside)), make(kind))
        if family == "usual" and rng.random() < 0.15:
            # An article may end with such a line of its own, which only its place tells.
            own = rng.choice(("All rights reserved.", "Published under a free license.", said("foot", rng.randint(2, 8)), said("side", rng.randint(2, 6))))
            inside.append(f"<p>\x02{own}</p>")
            articles = True
        else:
            articles = False
        text = "".join(inside)
        if family == "tables":
            row = lambda *cells: "<tr>" + "".join(f"<td{rng.choice(('', ' valign=top', ' width=150'))}>{c}</td>" for c in cells) + "</tr>"
            left, right = "".join(before[1::2]) or told("nav"), "".join(after[1::2])
            middle = text if rng.random() < 0.6 else f"<table>{row(text)}</table>"
            cells = [left, middle, right] if right and rng.random() < 0.6 else [left, middle] if rng.random() < 0.8 else [middle, left]
            rows = [row("".join(before[::2])), row(*cells), row("".join(after[::2]))]
            return f"<table{rng.choice(('', ' border=0', ' width=100%'))}>{''.join(r for r in rows if '><' in r[4:] or len(r) > 30)}</table>"
        if family == "bare":
            return "".join((*before, text, *after)) if rng.random() < 0.5 else f"<div>{''.join(before)}</div><div>{text}</div><div>{''.join(after)}</div>"
        if family == "unnamed":
            box = rng.choice((("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<section>", "</section>"), ('<div class="c1">', "</div>")))
            return random_names(f"<div class=a>{''.join(before)}</div>{box[0]}{text}{box[1]}<div class=b>{''.join(after)}</div>")
        if family == "roles":
            box = rng.choice((('<div role="main">', "</div>"), ('<div role="article">', "</div>"), ("<main>", "</main>"), ("<main><section>", "</section></main>"), ('<section role="main">', "</section>")))
            roles = {"<nav": '<div role="navigation"', "</nav": "</div", "<aside": '<div role="complementary"', "</aside": "</div", "<footer": '<div role="contentinfo"', "</footer": "</div"}
            around = ["".join(before), "".join(after)]
            if rng.random() < 0.7:
                for old, new in roles.items():
                    around = [x.replace(old, new) for x in around]
            return f"{around[0]}{box[0]}{text}{box[1]}{around[1]}"
        r = rng.random()
        if r < 0.35 or articles:
            box = ("<article>", "</article>")
        elif r < 0.6:
            box = ("<main>", "</main>") if rng.random() < 0.6 else ("<main><article>", "</article></main>")
        elif r < 0.95:
            tag = rng.choice(("div", "div", "section"))
            box = (f"<{tag}{names('content', 'post', 'article', 'story', 'entry-content', 'article-body', 'post-content', 'main', 'main-content', 'text', 'body', 'entry', 'page', 'single')}>", f"</{tag}>")
            if rng.random() < 0.3:
                box = ('<div class="container">' + box[0], box[1] + "</div>")
        else:
            box = ("", "")
        return "".join((*before, box[0], text, box[1], *after))

    for i in range(count):
        body = page(families[i % len(families)] if rng.random() < 0.6 or "usual" not in families else "usual")
        if rng.random() < 0.25:
            body = f"<div{names('wrapper', 'page', 'container', 'site', 'root')}>{body}</div>"
        yield f"<html><head><title>{word()}</title><script>x()</script></head><body>{body}</body></html>"


def _built(seed: int = SEED, count: int = BUILT, families: tuple[str, ...] = FAMILIES) -> tuple[list[list[Block]], list[np.ndarray]]:
    pages, labels = [], []
    for page in _layouts(seed, count, families):
        found = blocks(page)
        labels.append(np.array(["\x02" in b.text for b in found], np.float32))
        pages.append([b._replace(text=b.text.replace("\x02", "") or "-") for b in found])
    return pages, labels


def _clutter(path: tuple) -> bool:
    """Whether the elements around a block say that it is none of the article; the header in an article is its own."""
    inside = False
    for tag, names in path:
        if inside and tag == "header" and not (CLUTTER - {"header"}) & set(names):
            continue
        if tag in CLUTTER or CLUTTER & set(names):
            return True
        inside |= tag == "article"
    return False


def _told(page: str) -> tuple[list[Block], np.ndarray] | None:
    """Blocks and labels of a page whose elements say what they hold."""
    found = blocks(page)
    inside = np.array([any(tag in ("article", "main") for tag, _ in b.path) and not _clutter(b.path) for b in found], np.float32)
    return (found, inside) if len(found) > 1 and inside.any() else None


@functools.lru_cache(maxsize=1)
def _base() -> tuple[Labeller, list[np.ndarray], list[np.ndarray]]:
    """The labeller of the built pages, which no table changes, and some of them to be learned again."""
    sequences, labels = _built()
    vectors, model = Vectors(), Labeller()
    pages = [vectors.of(s) for s in sequences]
    model.train(pages, labels)
    return model, pages[:BESIDE], labels[:BESIDE]


def train(pages: list[str]) -> Labeller:
    """A labeller from built pages and those of ``pages`` whose elements say what they hold."""
    base, sequences, labels = _base()
    model = copy.deepcopy(base)
    told, vectors = [x for x in map(_told, pages) if x], Vectors()
    if told:
        model.train([*sequences, *(vectors.of(s) for s, _ in told)], [*labels, *(y for _, y in told)], MORE_EPOCHS, MORE_RATE)
    return model


def fit(pages: DataFrame) -> Labeller:
    hashed = F.xxhash64(F.lit("page"), F.col("page_id"))
    usable = pages.where("html IS NOT NULL AND length(html) BETWEEN 1 AND %d" % LARGEST).select(hashed.alias("h"), "html")
    # Twice the rows that are needed, by the hash, so that not every task sends as many.
    share = min(1.0, 2.0 * SAMPLE / max(1, pages.count()))
    few = usable.where(F.pmod("h", F.lit(1 << 20)) <= share * (1 << 20)).orderBy("h", "html").limit(SAMPLE)
    return train([r["html"] for r in few.collect()])


def main_text(page: str, model: Labeller, vectors: Vectors) -> str:
    found = blocks(page)
    prob = model.predict([vectors.of(found)])[0] if found else ()
    return " ".join(b.text for b, p in zip(found, prob) if p >= 0.5)


_TOGETHER = 64


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) for every row."""
    common.bounded(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, vectors = held.value, Vectors()
        for batch in batches:
            for low in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(low, _TOGETHER)
                found = [blocks(x.as_py() or "") for x in part.column(2)]
                probs = labeller.predict([vectors.of(f) if f else np.zeros((0, DIM), np.float32) for f in found])
                kept = [[b.text for b, p in zip(f, pr) if p >= 0.5] for f, pr in zip(found, probs)]
                texts = [" ".join(k) for k in kept]
                cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(map(len, kept), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")


def op6_html(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
