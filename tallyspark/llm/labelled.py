"""Paragraphs with known sentence boundaries, composed from hand-made sentences; the boundary tagger is fitted on them.

Every sentence below is one unit. ``paragraphs`` joins sentences of a language in random order by the gaps that the
language writes (blanks, a wrapped line, none), so each boundary is known from how the text was made. ``{n}`` stands for a
number, ``{N}`` for a name, ``{C}`` for a code, ``{S}`` for another
sentence without quotes, ``{w}`` for a word in lower case and ``{f}`` for a file name. For the script without marks the
sentences are written with marks, which are stripped from the text while the boundaries stay.
"""

from __future__ import annotations

import random
import unicodedata

#: Paragraphs of each language, and the seed they are drawn with.
PARAGRAPHS, SEED = 260, 17

ENGLISH = """
berth is text, not a number.|tonnage is a number, see the tonnage list.|cargo is empty in {n} rows.|It took 8 s.|It took {n} h.|Dock B. is shut.
It opens at 9 a.m. Eastern time.|The gate shut at 10 p.m. GMT.
It closes at 9 p.m. {N} time.|It shut at 11 p.m. Pacific time on Monday.|The U.S. {N} team lost.|The U.K. Treasury paid.|{w}_log v. {w}_map is still open.|It was read from {w}_log.|We took {f} instead of {w}_map.|See no. {w}_log, sec. {w}_map.|Acme Corp. {N} was sold.|The Ph.D. {N} holds is old.|Now {w}_log is empty.
He said: "{S} {S}"|"{S} {S}" said {N}.|({S})|He wrote: "{S}"|The sign "{S} {S}" hung there.|It rose... or so we hope.|The sign (it read {w}. {w}!) fell.
The berth {C} is free, e.g. for {C}.|{C} left late, i.e. after {C}.|He replied: "No. {C} first."|"Is {C} in?" asked {N}.|We towed {C}.|It was {C} vs. {C}.|As in the U.S. Navy, all wait.|See {f} for {C}.|The {N} Inc. boats came back.|He said "wait" and left {C}.|At 5 p.m. {N} left.|At 8 a.m. the gate opens.|The boats of J. {N} Ltd. sail from the U.K. coast.
It holds (cf. {C}).|Answer in one word.|A letter "from {N}" lay there.|Prices rose by {n}%... or so they say.|The {N} U. team lost.|They asked: "Why? {N} is here!"|("It is over," he said.)|In the U.S. and the U.K. it is sold.|{n} to {n}, i.e. wider.|Ms. {N} met Mr. {N} in the U.S.|No. {n} was lost.|The word "tide." was missing.|It was {N}'s boat.|Which boats of {C} came, and when?
The harbour was closed at noon.|A second crew took over the shift.|Why did the pump stop?|Nobody answered!|In winter the road is icy.|After the storm, {n} roofs were gone.|Since then it has been quiet.|We counted {n} boats.
{N} wrote the summary.|She left early.|It was fine.|Most of the crates, boxes, etc. were empty.|Mr. {N} and Ms. {N} signed it on Tue. {n}, as planned.|Dr. {N} asked for more time.|Prof. {N} et al. found {n} cases.|The ferry left at 7 p.m. on Monday.
The ferry left at 6 a.m. Central time.|Most of it was sold in the U.S. market.|They moved to the U.K. branch last May.|It was built in the U.S.|They came home at 9 p.m.|We pack ropes, hooks, sails, etc.|See fig. {n} and sec. 4.1 for the map, cf. no. {n} of the log.
The toll (see sec. 2.3) went up.|(The full log is kept in annex C.4 of the binder.)|(It rained.)|He said: "It is late. Go home."|He said: "We are done."|"Is the tide in?" asked the guard.|"Stop!" she cried and ran.|"We won."|The sign read "closed! come back later" all week.
Hold on... the two maps differ.|The wind fell... and the sea was calm.|So it ended...|It rose from 3.5 to 4.25 m, i.e. by {n} cm.|Version v3.1.4 is faster than v2.0.|Open {f} before you start.|Visit https://www.harbour.example/a/b.html?x=1.2 for times.|Run `boat.sail(x != 0).stop()` twice.
{w}_log was emptied at 04:30.|{w} is a word, not a number.|{n} crates were lost.|{n} of {n} crates came back!|J. {N} led the crew.|Both {N} and J. R. {N} led it.|A fee is no tax.|Acme Inc. paid {n} dollars, {N} Corp. nothing.|Acme Ltd. is on the list, vs. {n} before.|It weighs approx. {n} kg, max. {n}.|Pay No. {n} first.|St. {N} is a small town.
The trip took 3 h. 20 min. this time.|The trip takes 3 h.|The width is 6 m.|Ph.D. students of {N} U. came, too.|It costs {n}%.|Is that so, e.g. in May?|Do it now.|What now?!|The quay [old part] was sold.|On the list: nails, tar, rope.|Three men stayed.|Once more, please.|Under oath he denied it.|Only two came.
Last week the bridge opened.|Between May and June it was shut.|According to {N}, it fell by {n}%, didn't it?|Compared with May, it rose.|Despite the rain they sailed.|The captain's log ends here.|Its cost was $4.50.|They moved to the U.S. in May.|The E.U. rules apply.
"""
GERMAN = """
Er las {w}_log.|Es steht in {f}.|Die Firma u. a. {N} fehlt.|Um 9 Uhr usw. {N} fehlte.
Er sagte: „{S} {S}“|„{S}“, sagte {N}.|({S})|Sie schrieb: „{S}“|Das kam am 3. {N} heraus, wie er am 4. Mai schrieb.
Es fehlen ca. {n} Boote, u. a. {C} und {C}.|Er kam, z. B. {C}.|Siehe ggf. {C}.|Das gilt für {C}, d. h. {N}.|Er antwortete: „Nein. {C} zuerst.“|{C} fehlt.|„Kommt {N} heute?“, fragte {N}.|Der Anteil im Hafen St. {N} stieg.|Im 2. Quartal kam {C}.|„Alles fertig.“|Am 3. {N} blieb niemand.|Vom 3. bis 5. Mai war zu.|Das Haus gehört Fr. {N}.|Nach dem 5. Boot war Schluss.|Sie rief: „Halt! Stehen bleiben!“
Der Hafen war mittags geschlossen.|Am 4. April kam das Schiff an.|Die Fahrt vom 12. Juni dauerte {n} Stunden.|Warum fiel die Pumpe aus?|Niemand wusste es!|Seit dem 1. Mai gilt das, d. h. für alle.|Es kostet 1.250,50 Euro, z. B. im Sommer.|Siehe Abs. 2 bzw. Kap. 3.1 des Buches, vgl. Nr. {n}.|„Ist das Tor zu?“, fragte der Wächter.|„Halt!“
Er sagte: „Nein. Komm später.“|Seile, Haken, Segel usw. liegen bereit.|Wir packen Seile, Haken usw.|Dr. {N} war ggf. dabei.|Prof. {N} schrieb es auf.|Die Brücke ist ca. {n} m lang.|Der Anteil sank um 2,5 %.|Version v1.2 läuft.|Öffne {f} zuerst.|{w}_alt wurde gelöscht.|{N} kam zu spät.|Hr. {N} blieb, u. a. wegen des Regens.|(Alles steht im Anhang B.3.)
Im Sommer ist es warm.|Nach der Flut war Ruhe, oder?|In {N} regnet es oft.|Bitte prüfen Sie {f} vor der Abfahrt!|Wann kommt das Boot?|Zum 3. Mal in Folge fehlt etwas.|Die Liste (siehe Abs. 4) ist lang.
"""
FRENCH = """
Il dit : « {S} {S} »|« {S} » dit {N}.|({S})|Elle répond : « {S} »
On prend p. ex. {C} ou {C}.|Il dit : « Oui. {C} d'abord. »|« {C} est-il là ? » demanda {N}.|{C} est parti.|Elle cite cf. {C}.|Voir p. ex. {N}.|Le lot {C} vient de Saint-{N}.|Attendez... {C} manque.|Le p. {n} manque.|« {N} est là ! » cria-t-il.|Et toi ?|Mlle {N} et M. {N} signent.|Il écrit : « Tout va bien. »|Est-ce fini ?|Le vol. {n} est là.
Le port était fermé à midi.|La digue date du 1er mars.|Pourquoi la pompe s'est-elle arrêtée ?|Personne n'a répondu !|M. {N} renvoie à l'art. 3.1 du code.|Mme {N} est partie tôt.|Il dit : « Non. Revenez demain. »|« La marée est-elle haute ? » demanda le garde.|« Arrêtez ! »|Cordes, crochets, voiles, etc. sont prêts.|On prend cordes, voiles, etc.
Il reste 1 250,75 euros, c.-à-d. 3,2 % du total.|On compare p. ex. mai à juin, cf. annexe {n}.|Ouvrez {f} avant le départ !|L'écart vient de {N}.|Dr. {N} est arrivé.|C'est fini...|Depuis mai, tout va bien.|(Voir l'annexe B.2.)|Elle coûte env. {n} euros.|À midi, il pleut.|Le 3 mai, {n} bateaux sont partis.|{w}_nuit est vide.|Version v2.1 est plus rapide.
"""
SPANISH = """
Dijo: «{S} {S}»|«{S}», dijo {N}.|({S})|Escribe: «{S}»
La lista trae {n} barcos, p. ej. {C}.|Dijo: «Sí. {C} primero.»|«¿Está {C} ahí?», preguntó {N}.|{C} salió.|Véase p. ej. {N}.|Hay {n} cajas, incl. {C}.|El lote {C} es de {N}.|El núm. {C} falta.|Lo cita el Dr. {N}.|«¡{N} está aquí!», gritó.|¡Alto!|Cuesta aprox. {C}.|El art. {n} lo dice.|La pág. {n} falta, cf. {C}.
El puerto cerró a mediodía.|La Sra. {N} cita el núm. {n}.|El Sr. {N} y el Dr. {N} firmaron.|¿Por qué paró la bomba?|¡No salgas!|Hay aprox. {n} barcos, incl. los viejos.|Pesa 3,5 kg, p. ej. en verano.|«¿Está abierta la puerta?», preguntó el guardia.|Dijo: «No. Vuelve mañana.»|«¡Alto!»|Compre cuerdas, velas, etc. para el viaje.|Compre cuerdas, velas, etc.
Revise {f} antes de salir.|Desde mayo todo va bien.|(Véase el anexo B.2.)|Espera... no es así.|En {N} llueve mucho.|El 3 de mayo salieron {n} barcos.|{w}_norte se vació a las 4:30.|¿Y ahora?|Subió un 2,5 %.|La Srta. {N} llegó tarde.
"""
CHINESE = """
他说：“{S}{S}”|“{S}”{N}说。|（{S}）|“{S}{S}”她又说。
他说：“不行。{C}先走。”|“{C}到了吗？”{N}问。|{C}已经离港。|“{C}不能走！”他喊道。|差别来自{C}……但还要看{N}。|按第3.2节，{C}停在{n}；其余不变。|《{N}手册》第{n}页有误。|(“已经结束。”)|{N}说“{C}。”然后走了。|P值{n}不能用。|{n}条记录为空。|请看{f}。
港口中午关闭。|第二班人员接班！|水泵为什么停了？|船长说：“不行。明天再来。”|“潮水涨了吗？”守卫问道。|“停下！”她喊了一声。|“我们赢了。”|他问：“门关了吗？”|请先打开{f}，再出发。|费用为3.5元，约占{n}%。|（详见附录B.2。）|(参见附录C.1。)|《航海日志》第{n}页写得很清楚。|{w}_log已经清空；其余不变。|风停了……海面平静。|差别约为{n}……但还要复查。|真的吗？！|{N}号船已经离港，对吗？|与5月相比，第3码头上升{n}位……至少看起来是这样。|表“旧港”已删除。|他称之为“奇迹！”的一天过去了。|在2.1版之后，航线改变了。|"开始吗？"船员问。
"""
JAPANESE = """
彼は「{S}{S}」と言いました。|「{S}」と{N}は答えました。|（{S}）
返事は「いいえ。{C}まで待ってください。」でした。|「{C}は来ましたか？」と{N}が聞きました。|{C}は出ました。|差は{C}です……{N}を見てください。|{N}は「はい。{C}です。」と答えました。|「{C}だ！」と叫びました。|{n}行が空です。|なぜ{C}は戻らないのですか？|{f}を見てください。|「終わりました。」
港は正午に閉まりました。|二番目の班が交代しました！|なぜポンプは止まりましたか？|船長は「だめです。明日来てください。」と言いました。|返事は「はい。すぐ行きます。」でした。|担当者は「門は閉めましたか？」と聞きました。|「止まれ！」と叫びました。|{f}を開いてから出発してください。|費用は約3.5円です。|（付録B.2を参照。）|風がやんだ……海は静かです。|差は約{n}ですが……もう一度確かめます。|表{w}_logは空です。|{N}号は出港しました。|本当ですか？！|版v2.1で航路が変わりました。|値段は{n}%上がりました。
"""
HINDI = """
उसने कहा, "{S} {S}"|"{S}" {N} ने कहा।|({S})
उसने कहा, "नहीं। {C} तक रुकिए।"|{C} चला गया।|"{C} कहाँ है?" {N} ने पूछा।|{n} नाव खाली हैं।|डॉ. {N} और डॉ. {N} आए।|सूची {C} में {n} नाम हैं!
बंदरगाह दोपहर में बंद था।|दूसरी टोली आ गई!|पंप क्यों रुका?|उसने कहा, "नहीं। कल आना।"|डॉ. {N} ने पैरा 3.1 देखने को कहा।|लागत 3.5% बढ़ी।|{f} पहले खोलें।|नाव दिनांक 2024-05-01 को चली।|सूची में {n} नाम हैं, जैसे {N}।|क्या यह सच है?|{w}_log खाली है।|"क्या दरवाज़ा बंद है?" पहरेदार ने पूछा।|(परिशिष्ट B.2 देखें।)|मई के बाद सब ठीक है।
"""
ARABIC = """
قال: "{S} {S}"|"{S}" قال {N}.|({S})
قال {N}: "لا. انتظروا {C}."|غادر {C}.|"أين {C}؟" سأل {N}.|د. {N} و د. {N} هنا.|{n} قاربا فارغة.|راجع {C}؛ ثم غادر!|قال: "نعم. عد غدا."
أغلق الميناء عند الظهر.|وصل الفريق الثاني!|لماذا توقفت المضخة؟|قال الحارس: "لا. عودوا غدا."|د. {N} راجع السجل؛ ثم غادر.|بلغت الكلفة 3.5% من المجموع.|افتح {f} أولا.|أبحرت السفينة بتاريخ 2024-05-01.|راجع الفقرة 3.1 من الدليل.|هل هذا صحيح؟|"هل الباب مغلق؟" سأل الحارس.|عاد {n} قاربا، منهم {N}.|(انظر الملحق B.2.)|بعد مايو صار كل شيء هادئا.
"""
#: Written with marks for their labels; the marks are stripped.
THAI = """
อากาศวันนี้ดีมาก.|อาคารหลังนี้ว่างมานาน.|หัวหน้าตอบว่าไม่ทราบ.|สินค้าลดราคาลงครึ่งหนึ่ง.|รายงานฉบับใหม่มาถึงแล้ว.|น้ำมันแพงขึ้นทุกเดือน.|ใครเป็นคนปิดไฟ?|พรุ่งนี้จะมีการประชุม.|ผู้จัดการร้าน {N} ลาออก.|บริษัทซื้อเรือ {n} ลำ.|ปีหน้าจะเริ่มใหม่.
ท่าเรือปิดตอนเที่ยง.|ลูกเรือชุดที่สองมาแล้ว!|ปั๊มหยุดทำงานทำไม?|กรุณาเปิดไฟล์ {f} ก่อนออกเดินทาง.|ตาราง {w}_log ว่างเปล่าแล้ว.|พบเรือที่หายไป {n} ลำในทะเล.|ค่าใช้จ่ายต้องไม่เกิน 3.5 ของทั้งหมด.|เราจะกลับมาอีกครั้งในเดือนหน้า.|ยังไม่มีใครตอบคำถามนี้.|ฝนตกหนักกว่าปีก่อนมาก.|คุณ {N} เขียนรายงานฉบับนี้.|เรือ {N} ออกจากท่าเวลา 04:30 น. ของวันนี้.|ลมสงบแล้ว, และทะเลก็เงียบ.|เขาอยากไป, แต่ไม่มีเวลา.|ต้องรอ, เพราะน้ำยังไม่ขึ้น.|เตรียมเชือก, ตะขอ, และใบเรือ.|เด็กๆ เล่นน้ำที่ชายหาด.|ประตูเก่าถูกขายไปแล้ว.|สะพานใหม่เปิดใช้เมื่อวาน.|กัปตันส่งสมุดบันทึกให้ทีมงาน.|ตลาดเหนือมีคนมากขึ้น.|ทีมงานตรวจรายชื่ออีกครั้ง.
"""
LANGUAGES = {"en": ENGLISH, "de": GERMAN, "fr": FRENCH, "es": SPANISH, "zh": CHINESE, "ja": JAPANESE, "hi": HINDI, "ar": ARABIC, "th": THAI}
#: What stands between two sentences of a language, as often as listed; most have a blank.
GAPS = {"zh": ["", "", "", "", "\n", " "], "ja": ["", "", "", "", "\n", " "]}
BLANKS = [" ", " ", " ", " ", "  ", "\n", "\r\n"]
#: Share of boundaries behind a plain point, and before a word that opens other sentences, at which the blank is missing.
GLUED = 0.06
#: Share of the blanks within a sentence that a line break replaces, and marks of sentences that don't stand in others.
WRAPPED, QUOTING = 0.08, frozenset("\"“”„«»「」()（）")
HEADS, TAILS = "Bel Dar Fen Gol Kav Lum Mor Nev Pal Ros Sil Tor Ul Van Wel".split(), "an bor da el fi gur ik lo men o ra sin tu vey".split()


def sentences(language: str) -> list[str]:
    """The hand-made sentences of a language with their slots open."""
    return [s for line in LANGUAGES[language].strip().splitlines() for s in line.split("|")]


def _filled(rng: random.Random, sentence: str, plain: list[str]) -> str:
    name = lambda: rng.choice(HEADS) + rng.choice(TAILS) + rng.choice(["", rng.choice(TAILS)])
    while "{" in sentence:
        at = sentence.index("{")
        kind = sentence[at + 1]
        put = {
            "n": lambda: rng.choice([str(rng.randint(2, 900)), f"{rng.randint(1, 40)}.{rng.randint(1, 99)}", f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{rng.randint(1, 90)},{rng.randint(100, 999)}"]),
            "N": name, "C": lambda: rng.choice(["K", "QX", "T", "B", "PO"]) + str(rng.randint(1, 4000)), "w": lambda: name().lower(), "S": lambda: _filled(rng, rng.choice(plain), plain), "f": lambda: f"{name().lower()}_{name().lower()}.{rng.choice(['csv', 'txt', 'md'])}",
        }[kind]()
        sentence = sentence[:at] + put + sentence[at + 3 :]
    return sentence


def stripped(text: str, ends: list[int]) -> tuple[str, list[int]]:
    """The text without marks that stand at the edge of a word, and its boundaries."""
    drop = [unicodedata.category(c)[0] in "PS" and not (0 < k < len(text) - 1 and text[k - 1].isalnum() and text[k + 1].isalnum()) for k, c in enumerate(text)]
    kept, out = 0, []
    where = [0]
    for c, gone in zip(text, drop, strict=True):
        kept += not gone
        where.append(kept)
        if not gone:
            out.append(c)
    return "".join(out), [where[e] for e in ends]


def paragraphs(count: int = PARAGRAPHS, seed: int = SEED) -> list[tuple[str, list[int], str]]:
    """(text, boundaries, language): the offset behind each sentence, the last one's included."""
    out = []
    for language in LANGUAGES:
        rng, known = random.Random(f"{seed} {language}"), sentences(language)
        plain = [s for s in known if not QUOTING & set(s) and "{S}" not in s]
        for _ in range(count * (3 if language == "en" else 1)):
            text, ends = "", []
            for _ in range(rng.randint(2, 6)):
                one = _filled(rng, rng.choice(known), plain)
                if language not in GAPS:
                    one = "".join("\n" if c == " " and rng.random() < WRAPPED else c for c in one)
                if text:
                    pointed = text[-1] == "." and text[-2].islower() and text[-3].isalpha() and one[0].isupper() and one[1:2].islower()
                    text += "" if pointed and rng.random() < GLUED else rng.choice(GAPS.get(language, BLANKS))
                text += one
                ends.append(len(text))
            out.append((*(stripped(text, ends) if language == "th" else (text, ends)), language))
    return out


def openings() -> frozenset[str]:
    """Words that begin sentences of the languages with capitals, other than names; those in lower case are marked with ~."""
    found = set()
    for language in ("en", "de", "fr", "es"):
        for s in sentences(language):
            word = s.lstrip("([\"«„¿¡").split()[0].strip(".,:;!?»“\")…")
            if word.isalpha() and word[0].isupper() and word not in ("Mr", "Dr", "Prof", "St", "J", "Acme", "M", "Mme", "Hr"):
                found.add(word.casefold())
            elif word.isalpha() and word[0].islower():
                found.add("~" + word)
    return frozenset(found)
