import pytest

from tallyspark.llm import labelled
from tallyspark.llm import sentences as S

CASES = [
    ["It took 6 s.", "channel is text, not a number.", "The rest was noise!", "channel is text, see the channel list.", 'She noted: "It is off by 4.1%."', "channel is text.", "(It holds.)", "channel is text."],
    ["Mr. Pefa and Ms. Gin met at 5 p.m. on Fri. 2026-05-28, as agreed.", "The U.S. stores rose by 3.5%.", "After it, nobody knew!"],
    ["It fell, as in the U.S.", "Since then, sales of e.g. lamps, chairs, etc. rose."],
    ["The snapshot ended at 11 p.m. Eastern time.", "In week 2, it rose to 15,558."],
    ['The reply was short: "No. Wait for Q2."', "After that, it rose."], ['"Is the watermark set?" asked the desk.', "In short, no."],
    ["Wait... the two exports disagree.", "snap_stock was rebuilt at 03:15."], ["(The full list sits in appendix B.2 of the playbook.)", "The rest (see sec. 3.4) holds."],
    ["Call `ds.filter(col != 0).sum()` first.", "See https://wiki.example.invalid/a/notes.html?v=2.1 for keys."],
    ["Am 14. Juli wurde es neu aufgebaut, vgl. Kap. 4.2, Abs. 3 des Leitfadens.", "Die Brücke schließt, z. B. in Nord."], ["„Ist der Stand vollständig?“, fragte das Team.", "Der Rabatt sank um 2,5 %!"],
    ["M. Sineron renvoie à l'art. 4.2 du guide.", "« Le filigrane est-il posé ? » demanda l'équipe.", "Le lot du 1er mars contient 6 lignes, c.-à-d. 1,6 % de plus."],
    ["Il répondit : « Non. Attendez Q4. »", "Le reste suit."], ["¿Por qué cae el margen?", "«¿Está completa la ventana?», preguntó el equipo.", "¡No sumes, p. ej. SO90!", "La Sra. Befo cita el núm. 14."],
    ["उन्होंने कहा, \"नहीं। Q1 तक रुकिए।\"", "डॉ. Bopil ने पैरा 4.2 देखने को कहा।", "लाभ क्यों नहीं बढ़ा?"], ["قال الفريق: \"لا. انتظروا حتى Q1.\"", "د. Nomobar راجع النتائج؛ ثم وافق عليها.", "لماذا؟"],
]
GLUED = [
    ["他问：“水位线设了吗？”", "“不要把去重数相加！”数据组再次提醒。", "《手册》写得很清楚……至少看起来如此。", "真的对得上吗？！", "(详见附录B.2。)"],
    ["担当者は「締め日は設定しましたか？」と聞きました。", "fct.csvを確認してください。", "差は約9.9ですが……再確認が必要です。"], ["Die Quote sank im Bericht.", "Version v2.14 rundet.", "Dr. Bo kam."],
]


@pytest.fixture(scope="module")
def model():
    trained = S.trained_model()
    return S.Model(trained.weights, trained.pairs, trained.starters | {"~channel", "after", "in", "since"})


def cut(model, text):
    return [text[a:b] for a, b in S.units(text, model)]


@pytest.mark.parametrize("parts", CASES, ids=lambda p: p[0][:12])
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\r\n"])
def test_sentences(model, parts, gap):
    assert cut(model, gap.join(parts)) == parts


@pytest.mark.parametrize("parts", GLUED, ids=lambda p: p[0][:12])
def test_sentences_without_blanks(model, parts):
    assert cut(model, "".join(parts)) == parts


def test_headings_lists_and_wrapped_lines(model):
    text = "1.2 Scope\n \nThe rest was\nnoise, d.\nh. little.\n\n\n1. cap at 0.6 (see 4.2)\n2. ask the U.S. stores. Then wait.\n3. rerun\r\n\r\n- one\n- two\nlines\n\nOpen points"
    assert cut(model, text) == ["1.2 Scope", "The rest was\nnoise, d.\nh. little.", "1. cap at 0.6 (see 4.2)", "2. ask the U.S. stores. Then wait.", "3. rerun", "- one", "- two\nlines", "Open points"]


def test_a_wrapped_dash_or_rank_is_no_marker(model):
    assert cut(model, "It lost 20 buyers\n- a third of it in Region 4. The rest was noise.") == ["It lost 20 buyers\n- a third of it in Region 4.", "The rest was noise."]
    assert cut(model, "Der Lauf vom\n3. Mai ist fertig. Die Brücke schließt.") == ["Der Lauf vom\n3. Mai ist fertig.", "Die Brücke schließt."]


def test_thai_blanks(model):
    one, two, three = "ตาราง fct_sales ถูกสร้างใหม่เมื่อเช้านี้", "ส่วนลดต้องไม่เกิน 0.6 ของราคาเต็ม", "ยังไม่มีใครยืนยันตัวเลขชุดนี้"
    assert cut(model, f"{one} {two} {three}") == [one, two, three]
    assert cut(model, f"{three}  {three}\n{three} Q2") == [three, three, f"{three} Q2"]


def test_offsets_count_code_points(model):
    text = " 😀 Gut 😀.\nDie Brücke. "
    assert [text[a:b] for a, b in S.units(text, model)][-1] == "Die Brücke."
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in S.units(text, model))


def test_odd_texts(model):
    assert [S.units(t, model) for t in (None, "", "  \n\t\r\n ")] == [[], [], []]
    assert cut(model, "...") == ["..."]
    assert cut(model, '"unclosed (quote. The end') and cut(model, "(" * 500 + "a." * 500)
    long = "The rest was noise. " * 20_000
    assert len(S.units(long, model)) == 20_000


#: Boundaries by hand in which the rules and a learnt model may differ: blanks within a sentence of the script without marks.
HARD = [
    ["เขาซื้อเชือก และกลับบ้าน", "วันนี้ร้านปิด"], ["ทีมงานอยากรอ แต่เรือออกแล้ว", "ราคาจึงลดลง"], ["งานล่าช้า เพราะฝนตก", "ยังไม่มีใครตอบ"], ["ช่วงบ่ายเขามาถึง", "พนักงานตรวจสินค้า และส่งรายงาน"],
]


def tagged(model, parts, gap):
    """(tags by hand, by the model, by the rules) of a text made of the parts."""
    text, ends = "", set()
    for s in parts:
        text += gap * bool(text) + s
        ends.add(len(text))
    from cascade import rule

    blocks = S.parse(text, model.starters)
    places = [q for b in blocks for q in b.places]
    return [q.end in ends for q in places], [t for b in blocks for t in model.decode(b.places)], [rule(q) for q in places]


def test_held_out_accuracy(model, monkeypatch):
    """On sentences cut by hand that took no part in the fit the model is right at least as often as a rule cascade."""
    import os

    monkeypatch.syspath_prepend(os.path.dirname(__file__))
    total = right = ruled = differ = 0
    for parts, gap in [(p, " ") for p in CASES + HARD] + [(p, "") for p in GLUED]:
        for hand, own, rule in zip(*tagged(model, parts, gap), strict=True):
            total, right, ruled, differ = total + 1, right + (own == hand), ruled + (rule == hand), differ + (own != rule)
    assert right >= 0.98 * total and right >= ruled and differ > 0


def test_labelled_boundaries_are_places():
    """Each boundary of the training text is one that the tagger may choose."""
    for text, ends, language in labelled.paragraphs(20, 5):
        places = {q.end for b in S.parse(text, labelled.openings()) for q in b.places}
        missing = [e for e in ends[:-1] if e not in places]
        assert not missing or language == "th", (text, missing)  # in Thai, blanks between other scripts are never free


def test_stripping_keeps_boundaries():
    text, ends = labelled.stripped("ab. (cd, 0.5) fct_x! e", [3, 20, 22])
    assert text == "ab cd 0.5 fct_x e" and [text[:e] for e in ends] == ["ab", "ab cd 0.5 fct_x", text]


def test_the_fit_is_repeatable():
    some = [(t, e) for t, e, _ in labelled.paragraphs(6, 3)]
    one, two = S.fit(some, labelled.openings()), S.fit(some, labelled.openings())
    assert one == two and one.weights


def test_frame(spark):
    docs = spark.createDataFrame([(1, "The rest was noise. In short, no.", "x"), (2, "The rest was noise. In short, no.", "x"), (3, None, "x"), (4, "", "x"), (None, "A.", "x")], "doc_id long, text string, start_char string")
    got = sorted(tuple(r) for r in S.sentence_units(docs, S.trained_model()).collect())
    assert got == [(d, a, b) for d in (1, 2) for a, b in ((0, 19), (20, 33))]
    assert S.sentence_units(docs.limit(0)).collect() == []
    assert S.sentence_units(docs).count() >= 2


def test_viterbi_against_all_taggings():
    import itertools

    model = S.Model({"a": 1.0, "b": -2.0, "c": 0.5}, {(True, True, "near"): -3.0, (False, True, "far"): 0.7, (True, False, "near"): 0.2}, frozenset())

    class Place:
        def __init__(self, end, f):
            self.end, self.f = end, f
            self.kind, self.before, self.after, self.gap, self.quote, self.left, self.right = "".join(f), "", "", "", "", "", ""

        def features(self):
            return self.f

    places = [Place(3, ("a",)), Place(5, ("a", "c")), Place(20, ("b",)), Place(22, ("c",)), Place(40, ("a", "b"))]

    def score(tags):
        total = 0.0
        for k, (p, t) in enumerate(zip(places, tags)):
            s = sum(model.weights[f] for f in p.f)
            total += s if t else -s
            if k:
                total += model.pairs.get((tags[k - 1], t, S._distance(places[k - 1], p)), 0.0)
        return total

    assert score(model.decode(places)) == max(score(list(t)) for t in itertools.product((False, True), repeat=5))


def test_starters_are_those_of_all_whole_documents(spark):
    """No text is cut, list items and codes begin no sentence, and rare openings of a large corpus are none."""
    texts = ["The rest was noise. " * 1100 + "What changed? Kefel rose.", "Kefel fell.", "Q2 rose.", "- Lamps", "- Lamps"] + ["Since May, all is well."] * 40 + ["Das gilt.", "Das gilt nicht.", ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    assert S.corpus_starters(docs) == {"the", "kefel", "since", "das"}
    assert S.model_for(docs.limit(0)).starters == S.trained_model().starters
    many = docs.unionByName(spark.createDataFrame([("Since May. " + "\n\nThe end." * 29_999,)], "text string").selectExpr("100L AS doc_id", "text"))
    assert S.corpus_starters(many) == {"the", "since"}
