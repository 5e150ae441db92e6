"""Garbled text from wrong character encodings (problem 8).

A hidden Markov model reads the characters of a text that are not ASCII.  It has one
clean state and one state for each pair (true encoding, encoding it was read with).
The clean state emits characters by a bigram model of letters, trained here on short
texts in the supported languages; the state of a pair emits exactly what the clean
model emits, sent through the pair's transformation, so that its probability of some
characters is the clean model's probability of what the inverse transformation makes
of them (none, if there is no inverse).  Characters that touch share a state.  The best
sequence of states (Viterbi) labels the text; each labelled span gets its state's
inverse transformation.

Defined results: null, empty, blank and pure ASCII texts without entities are clean;
replacement characters are reported and stay as they are, everything else that can be
recovered is; equal rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND_SCHEMA = "doc_id long, states array<string>, spans int, recovered boolean, restored string"

#: Training text of the clean model, written for it: everyday sentences with the letters and signs of each language.
SAMPLES = """
Grandmother’s café on the corner still sells crème brûlée – “the best in town” — for 4 € 50; she’d never say it’s expensive, and we’re glad … Zoë’s fiancé ordered a soufflé, two éclairs & a piña colada. It wasn’t cold (21 °C ± 1), so we sat outside § 2 • north terrace • till ½ past nine. ‘Naïve’, they’ll say; that’s fine. © 2019 Brontë Ltd ® ™, 3 × 4 = 12, 8 ÷ 2, 5 m² and 6 m³, 250 µs, 12 µm, 30 £, 900 ¥, ¶ 7, déjà vu, smörgåsbord, jalapeño, façade, résumé, über-cool, coöperative. I’d, you’ll, he’s, don’t, can’t, isn’t, doesn’t, won’t, they’ve, let’s. “Yes,” “no” — “maybe”. The ‘quoted’ word. Chapter → section → page, ← back, ↑ up, ↓ down.
┌──────┬─────┐ │ left │ mid │ ├──────┼─────┤ │ x ≤ y │ a ≥ b │ └──────┴─────┘ ╔══╗ ║ ok ║ ╚══╝ ✓ yes ✗ no ★ ☆ ≠ ≈ ∞ √ ∑ ∫ π λ α β γ δ Ω ■ □ ▪ ● ○ ◆ 😀 🚀 ✅ ❌ ⚠ │ ├── one │ └── two
Im Frühling blühen überall die Bäume, und die Vögel fliegen zurück über die grünen Hügel. Meine Großmutter backt süße Brötchen mit Käse, während der Großvater draußen die Äpfel pflückt. Natürlich müssen die Kinder früh aufstehen, weil die Schule schon um fünf nach acht anfängt; später dürfen sie spielen, wofür sie sich höflich bedanken. Der Zug nach München fährt heute verspätet ab, da auf der Brücke ein Stück Gleis beschädigt wurde. „Schöne Grüße!“, rief der Bäcker, ‚bis nächste Woche‘. Österreich, Übermut, Ähre, Ölbild, Straße, weiß, heiß, Fuß, Schloß, groß, größer, Maß, außerdem, schließlich, Füße, Geräusch, Träume, Häuser, Mäuse, Löwe, Körper, König, möglich, nötig, gehört, hören, können, könnte, würde, wünschen, Tür, für, über, drüben, Küche, Bücher, Mühle, kühl, glücklich, Stück, Rücken, Lücke, zurückgekehrt, Prüfung, erfüllt, Gefühl, ungefähr, Gewächs, wächst, erzählt, gewählt, Zähne, Nähe, ähnlich, Änderung, ergänzt, längst, Länder, Hände, Wände, vollständig, verfügbar, zuständig, ständig, Größe, löschen, öffnen, Höhe, böse, Verstöße, Übersetzung, ÜBERRASCHUNG, GRÖSSE, ÄNDERUNG, ÖFFNUNG, MÜSSEN, FÜR.
Hier, à l’aube, un vieux pêcheur a quitté le port de Sète ; il espérait ramener assez de crevettes pour fêter l’anniversaire de sa nièce. « Où vas-tu si tôt ? » lui a demandé le boulanger, très étonné. Après la tempête, la rivière était déjà montée jusqu’à la forêt, où des chênes âgés penchaient. Le maître a répété la leçon à ses élèves : ça n’a guère plu à Noëlle, qui préférait dessiner une île, un château, des bêtes étranges et un cœur. Là-bas, l’été paraît plus léger ; on goûte des pâtes, des gâteaux, du maïs et des mûres sûrement sucrées. Être, même, tête, fenêtre, arrêter, prêt, intérêt, enquête, hôpital, hôte, rôle, bientôt, côté, contrôle, dôme, août, coûter, sûr, dû, reçu, déçu, façade, français, garçon, commerçant, œuvre, sœur, bœuf, vœu, naïf, Haïti, Israël, aiguë, ambiguë, où, à, là, voilà, déjà, deçà, problème, système, deuxième, règle, père, mère, lumière, dernière, première, manière, complète, succès, accès, près, très, après, caractère, modèle, siècle, préféré, créé, année, journée, idée, musée, armée, vérité, société, qualité, sécurité, école, étude, état, était, été, être, égal, élever, énergie, échec, À, É, È, Ê, Ç, Î, Ô, Œ, ÉTÉ, ÉCOLE, À BIENTÔT, FRANÇAIS, « oui », l’eau, d’abord, qu’elle, s’il, n’est, j’ai, aujourd’hui, c’est.
El año pasado, mi tía Begoña viajó en avión a Canarias; allí conoció a un pingüino pequeño y a un niño muy simpático. ¿Quién llamó ayer por teléfono? ¡Qué lástima que no esté aquí! Después de la tormenta, el jardín quedó húmedo y el árbol más viejo perdió ocho ramas. Mi corazón late rápido cuando oigo una canción de cuna en otoño. Los cigüeñas vuelven en marzo, según contaba el señor Núñez, dueño del café de la esquina. España, mañana, montaña, cabaña, sueño, baño, daño, enseñar, compañero, tamaño, señal, español, cumpleaños, araña, leña, así, aquí, allí, ahí, también, además, jamás, quizás, detrás, atrás, café, bebé, inglés, francés, interés, después, través, algún, ningún, común, según, razón, ratón, camión, estación, atención, lección, acción, información, dirección, conexión, opinión, reunión, decisión, versión, solución, situación, operación, función, número, último, público, música, médico, rápido, técnico, página, fábrica, máquina, cámara, lámpara, sábado, árbol, fácil, difícil, útil, móvil, lápiz, azúcar, día, todavía, país, raíz, oído, tenía, había, sería, podía, María, río, frío, tío, energía, vacío, período, búsqueda, índice, límite, título, capítulo, vehículo, sí, mí, él, tú, qué, cómo, cuándo, dónde, cuál, vergüenza, lingüística, Óscar, Ángel, Él, Índice, Último, ¿Cómo?, ¿Por qué?, ¡Adiós!, AÑO, INFORMACIÓN, ATENCIÓN, PÁGINA, NÚMERO, ESPAÑOL.
Ontem à noite, o avô do João comprou pão, limões e maçãs na praça; amanhã irá à estação buscar as irmãs. Você já provou a sobremesa que a mãe da Conceição fez no verão? Não há ninguém na rua: só um cão, três pássaros e um violão esquecido. Às vezes chove muito em Março, e então o rio cresce até às árvores da outra margem. Coração, paixão, lição, canção, atenção, estação, informação, educação, situação, solução, opinião, reunião, avião, televisão, decisão, razão, mão, mãos, irmão, verão, são, tão, então, não, chão, botão, portão, leões, ações, lições, opiniões, razões, nações, informações, põe, põem, compõe, mãe, mães, cães, alemães, manhã, lã, irmã, maçã, você, vocês, três, mês, português, inglês, francês, gênero, ciência, experiência, importância, distância, frequência, avó, avô, só, nós, após, história, memória, vitória, necessário, horário, salário, contrário, dicionário, usuário, próprio, próximo, último, número, único, público, médico, música, página, máquina, prática, política, língua, água, área, série, matéria, família, notícia, início, princípio, exercício, edifício, difícil, fácil, possível, disponível, nível, útil, também, alguém, porém, além, até, café, pé, é, há, já, lá, está, estará, será, açúcar, cabeça, força, preço, serviço, almoço, começar, aço, à, às, àquela, ônibus, âncora, lâmpada, câmara, Ângela, Índia, Ásia, Óleo, Última, NÃO, SÃO, ATENÇÃO, EDUCAÇÃO, PÁGINA, MEMÓRIA, NÚMERO, HISTÓRIA, VOCÊ, LÍNGUA, INÍCIO, ÁREA, POSSÍVEL, AÇÕES, SERVIÇO, CÓDIGO, ÚNICO.
Рано утром старый рыбак вышел на берег и долго смотрел, как поднимается туман над холодной рекой. В нашем саду растут яблони, груши и вишни; осенью мы собираем урожай и варим варенье. Объявление висело у подъезда, но никто его не заметил. Хорошо ли ты знаешь этот город? Ещё вчера здесь шумел рынок, а сегодня тихо, будто все уехали. Цыплёнок испугался щенка и спрятался за ящик. Мой дядя живёт в Екатеринбурге, учит физику и пишет стихи. Жёлтый фонарь освещал мокрую улицу, где юноша ждал последний трамвай. Эти люди всегда помогают друг другу, поэтому их любят соседи. Чем больше читаешь, тем яснее понимаешь мысль автора. Поезд пришёл вовремя, пассажиры вышли, двери закрылись. Для каждого ученика учитель нашёл доброе слово. Зимой озеро покрывается льдом, и дети катаются на коньках. Бабушка испекла пирог с капустой, а дедушка починил забор. Необходимо помнить: время идёт, ничего не возвращается само. Съёмка фильма началась в июле, актёры приехали из Харькова, Одессы и Тюмени. Шёл дождь, гремел гром, сверкали молнии. Вопрос, ответ, ошибка, правило, пример, страница, строка, слово, буква, число, список, порядок, память, работа, время, место, начало, конец, причина, условие, значение, проверка, изменение, состояние, решение, сообщение, который, которая, которые, может, должен, только, если, когда, чтобы, потому, после, перед, между, через, также, без, при, для, или, ещё, уже, её, всё, моё, Наш, Ваш, Его, Она, Они, Это, Этот, Так, Тут, Уже, Фома, Хлеб, Цена, Час, Шаг, Щука, Эхо, Юлия, Яна, Жук, Зонт, Игра, Йод, Книга, Лес, Мир, Ночь, Окно, Пол, Рис, Сад, Три, Ухо. ОТКРЫТО ЕЖЕДНЕВНО. ВХОД ЗАПРЕЩЁН. ОСТОРОЖНО, СКОЛЬЗКО. БЕРЕГИТЕ ЛЕС ОТ ПОЖАРА. ЦЕНЫ СНИЖЕНЫ. ЮЖНЫЙ ФЛОТ. ЭКСПРЕСС. ЩЁЛОЧЬ. ЧУЖИЕ МЫСЛИ. ЖЁЛТЫЕ ЯГОДЫ.
Wczoraj późnym wieczorem mały chłopiec zgubił się w gęstym lesie, ale dzięki świecącemu księżycowi odnalazł ścieżkę. Babcia Bożena gotuje żurek, piecze sękacz i robi pierogi z gęsią; dziadek łowi ryby w jeziorze Śniardwy. „Cóż to za dźwięk?” – spytała Małgośka, śpiąca jeszcze pod kołdrą. Jesienią żółte liście spadają na ulicę, a dzieci zbierają żołędzie i kasztany. Mój brat źle się czuł, więc poszliśmy do lekarza przy ulicy Łąkowej. Ćwierkanie wróbli budzi mnie każdego dnia o piątej. Gdańsk, Łódź, Kraków, Poznań, Świdnica, Żary, Źródła, Ósemka, Ćmielów, być, iść, robić, mówić, zrobić, pisać, czytać, wiedzieć, widzieć, chcieć, mieć, dać, brać, stać, znać, wziąć, zacząć, zająć, minąć, płynąć, ciągnąć, są, mają, idą, robią, będą, będzie, będę, muszę, mogę, proszę, dziękuję, się, cię, mnię, imię, zwierzę, ręka, ręce, noga, język, książka, księga, święto, święty, szczęście, część, część druga, pamięć, pięć, dziesięć, dziewięć, sześć, gość, kość, złość, miłość, radość, wolność, jakość, wartość, możliwość, odpowiedź, gałęzie, łódka, łatwy, łóżko, mały, stały, cały, był, była, było, byłem, zrobił, mógł, głos, głowa, główny, długi, tłum, słowo, słońce, słoń, koń, dłoń, tydzień, dzień, styczeń, wrzesień, państwo, hiszpański, również, też, już, żeby, że, każdy, może, różny, morze, żaba, żona, życie, duży, środa, środek, śnieg, świat, światło, ścisły, źródło, źrebak, późno, raźno, bliźni, któż, który, która, których, wóz, mróz, góra, córka, stół, szkół, ósmy, ogół, powód, gotów, ŻYCIE, ŚWIAT, ŁĄKA, ŹRÓDŁO, UWAGA: ŚLISKO, WEJŚCIE WZBRONIONE, PROSZĘ NIE DOTYKAĆ, CZĘŚĆ, ĆWICZENIE, GŁÓWNY, „tak”, „nie”, „może”.
"""  # fmt: skip

_C1 = {b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_LEFT = -6.0  # entering a garbled state
_BACK = -1.0  # returning to the clean state
_OTHER = -12.0  # from one garbled state to another
_FLOOR = math.log(2e-6)
_CUT = 4.0  # a span must be so much likelier garbled than clean


@lru_cache(None)
def _encode_table(codec: str) -> dict[str, int]:
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    if codec == "cp1252":  # as browsers read it: unused bytes and latin-1 controls are themselves
        table |= {chr(b): b for b in range(0x80, 0xA0)}
    return table


def _undo(text: str, true: str, read: str) -> str | None:
    """What the characters were before bytes of ``true`` were read as ``read``."""
    table = _encode_table(read)
    try:
        data = bytes(table[c] for c in text)
    except KeyError:
        return None
    try:
        if true == "cp1252":
            return "".join(_C1.get(b) or bytes([b]).decode("cp1252") for b in data)
        return data.decode(true)
    except UnicodeDecodeError:
        return None


#: (true encoding, read with), or a chain of them, undone from the left
PAIRS: tuple[tuple[tuple[str, str], ...], ...] = (
    *(((("utf-8", r)),) for r in ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "cp852", "iso8859_2", "iso8859_15")),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("utf-8", "cp1252"), ("utf-8", "cp1252"), ("utf-8", "cp1252")), (("utf-8", "cp1250"), ("utf-8", "cp1250")), (("utf-8", "cp1251"), ("utf-8", "cp1251")),
    (("utf-8", "mac_roman"), ("utf-8", "mac_roman")), (("utf-8", "mac_roman"), ("utf-8", "cp1252")), (("utf-8", "cp1252"), ("utf-8", "mac_roman")), (("utf-8", "cp437"), ("utf-8", "cp437")), (("utf-8", "cp850"), ("utf-8", "cp850")),
    (("cp1250", "cp1252"),), (("iso8859_2", "cp1252"),), (("cp1251", "cp1252"),), (("koi8_r", "cp1252"),), (("cp866", "cp1252"),), (("iso8859_5", "cp1252"),),
    (("koi8_r", "cp1251"),), (("cp1251", "koi8_r"),), (("cp866", "cp1251"),), (("cp1251", "cp866"),), (("koi8_r", "cp866"),), (("cp866", "koi8_r"),), (("iso8859_5", "cp1251"),),
    (("mac_roman", "cp1252"),), (("cp1252", "mac_roman"),), (("cp437", "cp1252"),), (("cp850", "cp1252"),), (("cp1252", "cp437"),), (("cp1252", "cp850"),), (("cp1252", "cp1250"),), (("cp1252", "cp1251"),), (("cp1250", "cp437"),), (("cp1250", "cp852"),), (("cp852", "cp1250"),), (("cp852", "cp1252"),), (("cp1252", "cp866"),), (("cp1252", "koi8_r"),),
)
NAMES = ("clean", *("; ".join(f"{t} as {r}" for t, r in p) for p in PAIRS), "replaced")

_ONE_BYTE = frozenset(k for k, p in enumerate(PAIRS, 1) if p[0][0] != "utf-8")
_SPREAD = 4.0  # how much likelier clean may be where a one-byte state spreads over its line

_RUN = re.compile(r"[^\x00-\x7f]+")
_ENTITY = re.compile(r"&(?:amp;)*(?:#(?:[xX][0-9A-Fa-f]{2,5}|[1-9]\d{2,6})|[A-Za-z][A-Za-z0-9]{1,24});")
#: what the JVM filters on; anything else holds no character a wrong encoding can have made
SUSPECT_JAVA = r"[^\x00-\x7f]|&#?[A-Za-z0-9]{2,25};"  # an entity escaped again holds one of the form &amp;


def _side(c: str) -> str:
    """The class of an ASCII neighbour, as a model symbol."""
    return "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else " "


class Model:
    """Bigrams of characters, ASCII folded to four classes, backed off to single characters and then to a floor."""

    def __init__(self, samples: str = SAMPLES):
        pairs, firsts, singles = Counter(), Counter(), Counter()
        self.kinds = {}
        prev = " "
        for c in samples:
            s = c if ord(c) > 127 and not c.isspace() else _side(c)
            if s != " " or prev != " ":
                pairs[prev, s] += 1
                firsts[prev] += 1
                singles[s] += 1
            prev = s
        total = sum(singles.values())
        self.log_single = {s: math.log(n / total) for s, n in singles.items()}
        self.log_pair = {}
        for (a, b), n in pairs.items():
            self.log_pair[a, b] = math.log(0.9 * n / firsts[a] + 0.1 * singles[b] / total)
        kinds: dict[tuple[str, str], int] = Counter()
        kind_of = self._kind
        kind_firsts = Counter()
        prev = " "
        for c in samples:
            s = c if ord(c) > 127 and not c.isspace() else _side(c)
            kinds[kind_of(prev), kind_of(s)] += 1
            kind_firsts[kind_of(prev)] += 1
            prev = s
        n_kinds = 11
        self.log_kind = lambda a, b: math.log((kinds[a, b] + 0.02) / (kind_firsts[a] + 0.02 * n_kinds))
        sizes = Counter()
        for s, n in singles.items():
            sizes[kind_of(s)] += n
        self.log_in_kind = {s: math.log((n + 0.5) / (sizes[kind_of(s)] + 20)) for s, n in singles.items()}
        self._memo: dict[tuple[str, str], float] = {}

    @staticmethod
    @lru_cache(100_000)
    def _kind(s: str) -> str:
        if s in "aA0 ":
            return s
        o = ord(s)
        if 0x400 <= o < 0x530:
            return "я" if s.islower() else "Я"
        if s.isalpha() and o < 0x250:
            return "é" if s.islower() else "É"
        if 0x2010 <= o <= 0x2027 or s in "«»‹›\xa0":
            return "”"
        return "─" if 0x2500 <= o < 0x2600 else "·"

    def pair(self, a: str, b: str) -> float:
        key = (a, b)
        known = self._memo.get(key)
        if known is None:
            # mixture of the pair itself and of its kinds
            seen = self.log_pair.get(key, -1e9)
            by_kind = self.log_kind(self._kind(a), self._kind(b)) + self.log_in_kind.get(b, _FLOOR / 1.6)
            hi, lo = max(seen + math.log(0.6), by_kind + math.log(0.4)), min(seen + math.log(0.6), by_kind + math.log(0.4))
            known = self._memo[key] = max(hi + math.log1p(math.exp(lo - hi)), _FLOOR)
        return known

    def run(self, left: str, run: str, right: str) -> float:
        a, total = left, 0.0
        for c in run:
            s = c if ord(c) > 127 and not c.isspace() else _side(c)
            total += self.pair(a, s)
            a = s
        return total + self.pair(a, right)


class Detector:
    def __init__(self) -> None:
        self.model = Model()
        self._known: dict[tuple[str, str, str], tuple[tuple[float, ...], tuple]] = {}

    def emissions(self, left: str, run: str, right: str) -> tuple:
        """(log-probability by state, undone text by state) of touching characters."""
        key = (left, run, right)
        found = self._known.get(key)
        if found is None:
            model = self.model
            clean = model.run(left, run, right)
            logs, texts = [clean], [run]
            for pair in PAIRS:
                text: str | None = run
                lost = False
                for true, read in pair:
                    parts = text
                    text = _undo(parts, true, read) if all(ord(c) > 127 for c in parts) else _undo_mixed(parts, true, read)
                    if text is None:
                        break
                # what a cut at a no-break space that became a space leaves
                if text is None and right == " " and len(pair) == 1 and pair[0][0] == "utf-8":
                    text, lost = _undo(run + "\xa0", *pair[0]), True
                one_byte = pair[0][0] != "utf-8"
                if text is None or text == run or "�" in text or one_byte and any(c.isspace() for c in text):
                    logs.append(-1e9)
                    texts.append(None)
                else:
                    # a letter that stands alone says nothing about a one-byte encoding
                    alone = lost or one_byte and len(run) == 1 and left == right == " "
                    logs.append(min(clean, model.run(left, text, right)) if alone else model.run(left, text, right))
                    texts.append(text)
            logs.append(-1.0 if "�" in run else -1e9)
            texts.append(run)
            if "�" in run:
                logs[0] = -1e9
            found = (tuple(logs), tuple(texts))
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[key] = found
        return found

    def label(self, text: str, cut: float = _CUT) -> list[tuple[int, int, int, str, float]]:
        """Spans (start, end, state, undone text, gain) of a text; gain is against the clean state."""
        plain, starts, ends = _unescape(text)
        runs = list(_RUN.finditer(plain))
        if not runs:
            return []
        states = range(1, len(NAMES))
        found = []
        for m in runs:
            a, b = m.span()
            found.append(self.emissions(_side(plain[a - 1]) if a else " ", m.group(), _side(plain[b]) if b < len(plain) else " "))
        # Viterbi with three kinds of transitions: stay, enter or leave, change
        live = sorted({s for logs, _ in found for s in states if logs[s] > -1e8})
        best_clean, scores = 0.0, dict.fromkeys(live, _LEFT)
        back: list[tuple[int, dict[int, int]]] = []
        for k, (logs, _) in enumerate(found):
            if k:
                top = max(live, key=scores.__getitem__) if live else 0
                from_clean = not live or best_clean >= scores[top] + _BACK
                new_clean = best_clean if from_clean else scores[top] + _BACK
                came = {}
                new = {}
                for s in live:
                    stay, enter, change = scores[s], best_clean + _LEFT, (scores[top] + _OTHER)
                    v = max(stay, enter, change)
                    came[s] = s if v == stay else 0 if v == enter else top
                    new[s] = v
                back.append((0 if from_clean else top, came))
                best_clean, scores = new_clean, new
            best_clean += logs[0]
            for s in live:
                scores[s] += logs[s]
        now = max(live, key=scores.__getitem__, default=0)
        now = now if live and scores[now] > best_clean else 0
        path = [now]
        for clean_from, came in reversed(back):
            now = clean_from if now == 0 else came[now]
            path.append(now)
        path.reverse()
        # one line was mostly read in one way: a one-byte state spreads over its line unless clean is much likelier
        of_line: dict[int, set[int]] = {}
        lines = [plain.count("\n", 0, runs[0].start())]
        for m, n in zip(runs, runs[1:]):
            lines.append(lines[-1] + plain.count("\n", m.end(), n.start()))
        for k, s in zip(lines, path):
            if s in _ONE_BYTE:
                of_line.setdefault(k, set()).add(s)
        for n, (k, s, (logs, texts)) in enumerate(zip(lines, path, found)):
            if s == 0 and len(of_line.get(k, ())) == 1:
                (t,) = of_line[k]
                if texts[t] is not None and logs[t] > logs[0] - _SPREAD:
                    path[n] = t
        out = []
        for m, s, (logs, texts) in zip(runs, path, found):
            if s:
                a, b = m.span()
                # a lone lead character whose no-break space became a space takes the space along
                out.append((starts[a], ends[b - 1], s, texts[s] if texts[s] is not None else m.group(), min(60.0, logs[s] - logs[0]) if logs[0] > -1e8 else 60.0))
        # spans of one state together must be much likelier garbled
        gain: dict[int, float] = {}
        for *_, s, _t, g in out:
            gain[s] = gain.get(s, 0.0) + max(g, 0.0)
        return [x for x in out if gain[x[2]] >= cut]

    def leftover(self, text: str, spans: list[tuple[int, int, int, str, float]]) -> bool:
        """Whether a line with a one-byte span keeps other characters beyond ASCII, of which nobody can say how they were read."""
        at = {(text.rfind("\n", 0, a), s) for a, _, s, _, _ in spans if s in _ONE_BYTE}
        for begin in {a for a, _ in at}:
            end = text.find("\n", begin + 1)
            inside = sorted((a, b) for a, b, *_ in spans if begin < a and (end < 0 or a < end))
            rest, last = "", begin + 1
            for a, b in inside:
                rest, last = rest + text[last:a], b
            if _RUN.search(rest + text[last: end if end >= 0 else len(text)]):
                return True
        return False


def _undo_mixed(text: str, true: str, read: str) -> str | None:
    return _RUN.sub(lambda m: _undo(m.group(), true, read) or "�", text)


def _unescape(text: str) -> tuple[str, list[int], list[int]]:
    """The text with entities of characters beyond ASCII replaced, and where each of its characters begins and ends."""
    if "&" not in text:
        n = len(text)
        return text, range(n), range(1, n + 1)
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    for m in _ENTITY.finditer(text):
        c = m.group()
        while len(c) > 1 and (less := html.unescape(c)) != c:
            c = less
        if len(c) != 1 or ord(c) < 128:
            continue
        out.append(text[at: m.start()])
        starts += range(at, m.start())
        ends += range(at + 1, m.start() + 1)
        out.append(c)
        starts.append(m.start())
        ends.append(m.end())
        at = m.end()
    out.append(text[at:])
    starts += range(at, len(text))
    ends += range(at + 1, len(text) + 1)
    return "".join(out), starts, ends


@lru_cache(1)
def detector() -> Detector:
    return Detector()


def _applied(text: str, spans: list) -> str:
    out, at = [], 0
    for a, b, _, t, _ in spans:
        out += [text[at:a], t]
        at = b
    return "".join([*out, text[at:]])


def restore(text: str) -> tuple[list[str], int, bool, str]:
    """(names of states, spans of the text, whether all is recovered, restored text).

    What is restored is labelled again until nothing garbled is left, so that text that
    was decoded wrongly more often than a state knows is unwound step by step; every step
    but the first shortens the text.  All is recovered if the last text has no place that
    any state explains better than the clean one, no character was replaced, and no line
    that one byte a character garbled keeps other characters beyond ASCII.
    """
    d = detector()
    first = spans = d.label(text)
    names = {NAMES[s[2]] for s in first}
    again = left = False
    while spans:
        left = left or d.leftover(text, spans)
        better = _applied(text, spans)
        if better == text or again and len(better) >= len(text):
            break
        text, again = better, True
        spans = d.label(text)
        names |= {NAMES[s[2]] for s in spans}
    whole = bool(first) and "replaced" not in names and not left and not d.label(text, 0.0)
    return sorted(names), len(first), whole, text


def find_garbled(documents: DataFrame) -> DataFrame:
    """Garbled documents (FOUND_SCHEMA).  Texts of plain ASCII never leave the JVM; there is no shuffle."""
    suspects = documents.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(SUSPECT_JAVA)).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                names, n, whole, restored = restore(text)
                if n:
                    out.append((doc, names, n, whole, restored))
            yield pd.DataFrame(out, columns=["doc_id", "states", "spans", "recovered", "restored"])

    return suspects.mapInPandas(run, FOUND_SCHEMA)
