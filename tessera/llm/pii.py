"""Problem 3: personal information inside free text, found through its disguises and replaced with typed placeholders.

Method: offset-preserving deobfuscation. Transducers normalise look-alike characters, at/dot disguises and spelled
digits, each keeping the source offset of every output character; identifiers are detected in the normalised text; the
spans are mapped back to the source, where they are replaced, so that the rest of the text stays as it was.

Kinds: email, idno, phone, address, name, tried in this order; what one has taken is masked for the next, so that a name
inside an email address is no name.

Scale: one pass, no shuffle; every row is handled alone and whole. Cheap tests decide which detectors run on a text.

Defined results: null and empty texts have no mentions and stay as they are; mentions are numbered per kind in the
order of their source offsets; repeated rows are reported as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "idno", "phone", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# Look-alikes of Latin letters and of signs in identifiers (one character for one).
LOOKALIKES = str.maketrans(
    "＠．－＋（）［］／：" + "авеорсухіјѕ" + "АВЕКМНОРСТУХІЈЅ" + "αονρτυ" + "‐‑‒–−",
    "@.-+()[]/:" + "abeopcyxijs" + "ABEKMHOPCTYXIJS" + "aovptu" + "-----",
)
FULLWIDTH = {0xFF10 + i: 0x30 + i for i in range(10)} | {0xFF21 + i: 0x41 + i for i in range(26)} | {0xFF41 + i: 0x61 + i for i in range(26)}
ONE_TO_ONE = LOOKALIKES | FULLWIDTH
INVISIBLE = re.compile("[​‌‍⁠﻿­]")

# The words for digits.
DIGIT_WORDS = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0", "zwo": "2"}
CJK_DIGITS = dict(zip("零一二三四五六七八九", "0123456789")) | {"〇": "0", "幺": "1"}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SAID = rf"(?:(?:double|treble|triple|doppel)[\s-]*)?(?:{_WORD})"
SPELLED = re.compile(rf"(?<!\w){_SAID}(?:[\s,-]+{_SAID}){{4,}}(?!\w)", re.I)
# Digits among the words, where a repeated digit is said.
SPELLED_MIXED = re.compile(rf"(?<![\w.-])(?:(?:\d{{1,4}}|{_SAID})[\s,-]+)*(?:double|treble|triple)[\s-]+(?:{_WORD})(?:[\s,-]+(?:\d{{1,4}}|{_SAID}))*(?![\w-])", re.I)
SPELLED_PART = re.compile(rf"\d+|(double|treble|triple|doppel)?[\s-]*({_WORD})", re.I)
SPELLED_CJK = re.compile("[零〇幺一二三四五六七八九]{7,}")
AT = re.compile(r"(?<=[A-Za-z0-9])\s*[\[({<]\s*(?:at|@|a|arroba|ät)\s*[\])}>]\s*(?=[A-Za-z0-9])", re.I)
DOT = re.compile(r"(?<=[A-Za-z0-9])\s*[\[({<]\s*(?:dot|punkt|punto|\.|点)\s*[\])}>]\s*(?=[A-Za-z0-9])", re.I)
BARE = re.compile(
    r"(?<![\w.+-])([A-Za-z0-9][\w.+-]*)(\s+(?:at|arroba|ät)\s+)([A-Za-z0-9-]+(?:(?:\s+(?:dot|punkt|punto)\s+|\.)[A-Za-z0-9-]+)*)(\s+(?:dot|punkt|punto)\s+)([A-Za-z]{2,})(?!\w)",
    re.I,
)
BARE_DOT = re.compile(r"\s+(?:dot|punkt|punto)\s+", re.I)

EMAIL = re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*\s?@\s?(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9])")

_S = r"[\s]{1,2}"
_SEP = r"(?:[\s]{1,2}|[.-])"
IDNO = re.compile(
    rf"(?<![\w/-])(?:"
    rf"[1-9]\d{{5}}\s?(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\s?\d{{3}}[\dXx]"  # resident identity number
    rf"|\d{{3}}(?:-\d\d-|{_S}\d\d{_S})\d{{4}}"  # social security number
    rf"|\d{{8}}(?:\s?-\s?|\s)?[A-HJ-NP-TV-Za-hj-np-tv-z]"  # DNI
    rf"|[A-Za-z]\d\d[A-Za-z]\d{{5}}[Dd]?"  # identity card
    rf")(?![\w])(?!-\d)"
)
PHONE = re.compile(
    rf"(?<![\w+/.-])(?:"
    rf"(?:\+?86{_SEP}?)?1[3-9]\d(?:{_SEP}?\d{{4}}){{2}}"  # China, mobile
    rf"|\(0\d{{2,3}}\)\s{{0,2}}\d{{7,8}}|0\d{{2,3}}-\d{{7,8}}"  # China, fixed
    rf"|\+1{_SEP}\(?\d{{3}}\)?{_SEP}\d{{3}}{_SEP}\d{{4}}|1-\d{{3}}-\d{{3}}-\d{{4}}"  # North America
    rf"|\(\d{{3}}\)\s{{0,2}}\d{{3}}-\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}"
    rf"|\+34{_SEP}?\d{{3}}{_SEP}?\d{{3}}{_SEP}?\d{{3}}"  # Spain
    rf"|\+49{_SEP}?(?:\(0\)\s?)?\d{{2,4}}(?:[\s/-]{{1,2}})?\d{{5}}(?:[\s-]{{1,2}})?\d{{3}}|0\d{{2,4}}/\d{{4,8}}(?:-\d{{1,4}})?"  # Germany
    rf"|(?:\+44{_SEP}?(?:\(0\)\s?)?|0)7\d{{3}}{_SEP}?\d{{6}}|(?:\+44{_SEP}?(?:\(0\)\s?)?|0)20{_SEP}7\d{{3}}{_SEP}\d{{4}}"  # United Kingdom
    rf")(?![\w])(?![-/]\d)"
)
# Any number with a country code, in any grouping, of as many digits as the plan of the world allows; and a national number in
# any grouping after a word for telephones. What is shaped like a date or an IP address is none.
_PART = r"(?:[^\S\n]?\(0\)[^\S\n]?|[^\S\n]?[(/–-][^\S\n]?|\)[^\S\n]{0,2}|[^\S\n]{1,2}\(?|\.|\)[-/])"
PHONE_ABROAD = re.compile(rf"(?<![A-Za-z0-9_+/.-])(?:\+|00(?=[1-9]\d{{0,2}}[\s(/.-]))[^\S\n]?\(?[1-9](?:{_PART}?\d){{7,14}}(?![A-Za-z0-9_])(?![-/]\d)")
# Words for telephones, and words that tell other numbers.
PHONE_WORD = (
    r"(?:(?<![A-Za-zäöüß])(?:tel|telephone|telefon(?:nummer|isch)?|teléfono|fono|phone|call(?: \w+)?|calling|mobile?|móvil|celular|cell|fax|landline|hotline|dial|ring|reach(?:able| me| us| him| her| them)|whatsapp|handy|festnetz|ruf|rufnummer|rufen"
    r"|anruf|anrufen|erreichbar|durchwahl|llam[aeá]\w*|marque)(?![A-Za-zäöüß])|电话|手机|座机|固话|拨打?|致电|来电|传真|热线|☎)"
)
_OTHER_NUMBER = r"(?:order|ticket|invoice|ref|build|version|bestell|rechnung|auftrag|pedido|factura|编号|订单|工单|单号|发票|证件|身份证|dni|ssn|ausweis)"
PHONE_SAID = re.compile(
    rf"(?i:{PHONE_WORD}(?:(?!{_OTHER_NUMBER})[^\d\n\x00+]){{0,24}}?)(?<![A-Za-z0-9_+/-])"
    rf"((?!(?:19|20)\d\d[-/.]\d\d?[-/.]\d)(?!\d\d?[-/.]\d\d?[-/.](?:19|20)\d\d)(?!\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\d))\(?\d(?:{_PART}?\d){{6,11}})(?![A-Za-z0-9_])(?![-/]\d)"
)
SEVEN_DIGITS = re.compile(r"\d(?:[^\d\n]{0,4}\d){6}")

_CAP = r"[A-ZÄÖÜÁÉÍÓÚÑ][\wäöüßáéíóúñ]+(?:-[A-ZÄÖÜ][\wäöüß]+)?"
_TOWN = rf"(?:[\s,]{{1,3}}(?:D-)?(?:\d{{5}}\s{{1,2}}){_CAP}|,\s{{1,2}}{_CAP}|[^\S\n]?\n{_CAP}(?=[\n.]|$))?"
# What streets are called.
STREET_EN = r"(?:Road|Lane|Avenue|Street|Drive|Close|Rd\.?|Ave\.?|St\.?)(?![\w])"
STREET_DE = r"(?:stra(?:ß|ss)e|str\.|weg|allee|platz|gasse|-Allee|-Stra(?:ß|ss)e|-Weg|-Platz|\s{1,2}Stra(?:ß|ss)e|\s{1,2}Allee)"
STREET_ES = r"(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino|Ronda)"
STREET_CJK = r"(?:路|街|大道|巷|胡同)"
ADDRESS = [
    re.compile(
        rf"(?<![\w/.-])(?:(?:Apt|Flat|Unit|Suite)\s{{1,2}}\w{{1,4}},\s{{1,2}})?\d{{1,4}}\s{{1,2}}{_CAP}(?:\s{{1,2}}{_CAP})?\s{{1,2}}"
        rf"{STREET_EN}(?:,\s{{1,2}}(?:Apt|Flat|Unit|Suite)\s{{1,2}}\w{{1,4}})?{_TOWN}"
    ),
    re.compile(
        rf"(?<!\w)(?:[A-ZÄÖÜ][\wäöüß]+-)?[A-ZÄÖÜ][\wäöüß]+{STREET_DE}"
        rf"\s{{1,2}}\d{{1,4}}[a-z]?(?!\w)(?:[\s,]{{1,3}}(?:D-)?\d{{5}}\s{{1,2}}{_CAP})?"
    ),
    re.compile(
        rf"(?<!\w){STREET_ES}\s{{0,2}}(?:del?\s{{1,2}}(?:la\s{{1,2}})?)?{_CAP}(?:\s{{1,2}}{_CAP})?,?\s{{1,2}}"
        rf"(?:n\.?[ºo°]\s{{0,2}})?\d{{1,4}}(?!\w)(?:,\s{{1,2}}\d{{1,2}}[º°]\s?\w?)?{_TOWN}"
    ),
    re.compile(
        r"(?![家住是在到点寄送])(?:[一-鿿]{2,4}?[市县]\s?)?(?:[一-鿿]{1,4}?[区县镇]\s?)?[一-鿿]{1,5}?" + STREET_CJK + r"\s?\d{1,4}\s?[号弄](?:\s?\d{1,4}\s?(?:栋|幢|号楼|单元|楼|室|号))*(?:\s?\d{1,4}(?!\d))?"
    ),
]
# The cheap test: one of the words that the patterns themselves need.
ADDRESS_SIGN = re.compile(rf"\s{STREET_EN}|{STREET_DE}\s|{STREET_ES}|{STREET_CJK}")

# Common given names.
GIVEN = frozenset(
    "Alma Anton Bruno Celia Elin Emil Felix Greta Hugo Ines Ivo Jonas Lars Lena Marek Milan Mirela Nadia Noemi Oskar Pavel Petra"
    " Rafael Rosa Simon Tilda Tobias Vera Yara Zora Anna Peter Thomas Michael Maria David Sarah Laura Julia Paul Martin Stefan"
    " Andreas Christian Sophie Lukas Jan Klaus Hans Jürgen Wolfgang Sabine Monika Carlos Juan José Luis Javier Carmen Lucía Pablo"
    " Sofía Miguel Antonio Elena Marta Diego John James Robert William Mary Linda Susan Karen Emma Olivia Jack George Emily Alice".split()
)
# The most common surnames, and titles.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
GIVEN_CJK = "祁黎苓徵沅筱茉菀蓁珩昀屹泠芷恺翊霖沐淮彧"
TITLES = r"(?:Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.|Herrn?|Frau|Sr\.|Sra\.|Don|Doña)"
CAPITAL = re.compile(r"[A-ZÁÉÍÓÚÑÄÖÜ][a-zäöüßáéíóúñ]+")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"  # a name may touch CJK text


def _name(flags: int, cap: str) -> re.Pattern:
    g = "(?:" + "|".join(sorted(GIVEN, key=len, reverse=True)) + ")"
    full = rf"{g}(?:-{g})?"
    return re.compile(
        rf"(?<![{LETTER}0-9.+-])(?:{TITLES}\s{{1,2}})?(?:{full}(?:\s{{1,2}}[A-Z]\.)?\s{{1,2}}{cap}(?:-{cap})?|{cap},[^\S\n]{{1,2}}{full}(?:\s{{1,2}}[A-Z]\.)?(?![^\S\n]+[A-Z][a-z]))(?![{LETTER}0-9@-])", flags
    )


NAME = _name(0, r"[A-ZÄÖÜÁÉÍÓÚÑ][a-zäöüßáéíóúñ]+")
NAME_ANY = _name(re.I, r"[A-Za-zäöüßáéíóúñÄÖÜÁÉÍÓÚÑ]{3,}")
TITLED = re.compile(rf"(?<!\w)(?<!\d\s)(?:Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.|Herrn?|Frau|Sr\.|Sra\.)\s{{1,2}}[A-ZÄÖÜ][a-zäöüß]+(?![\w-])")
# Names of no list are known by where they stand: as the value of a person's field, as a signature, and beside the words of what
# people do. These words, and the words of what is no person.
_THING = (
    "Team|Group|Gruppe|Equipo|Grupo|Desk|Office|Büro|Oficina|Project|Projekt|Proyecto|Station|Site|Standort|Platform|Plattform|Plataforma|Service|Dienst|Servicio|System|Sistema|Server|Department|Abteilung|Support"
    "|Committee|Board|University|Company|Bank|Court|Hospital|Lab|Labor|Laboratorio|Center|Centre|Zentrum|Centro|Road|Street|Avenue|Lane|Drive|The|This|That|These|Those|Der|Die|Das|El|La|Los|Las"
)
_ONE = r"(?:(?:[A-Z][’'])?[A-ZÄÖÜÁÉÍÓÚÑ][a-zäöüßáéíóúñ]+(?:[-’'][A-ZÄÖÜÁÉÍÓÚÑ][a-zäöüßáéíóúñ]+)?)"
_PERSON = rf"(?!(?:{_ONE}\s+)?(?:{_THING})\b){_ONE}(?:\s[A-Z]\.)?(?:\s(?:van|von|de|der|den|del|la|al|bin))?\s(?!(?:{_THING})\b){_ONE}(?:[^\S\n](?!(?:{_THING})\b){_ONE})?"
_LATIN_FIELD = "contact|owner|author|reviewer|assignee|reporter|editor|approver|signed by|created by|confirmed by|Ansprechpartner|Verfasser|Autor|Autorin|Bearbeiter|Kontakt|responsable|contacto|revisor|firmado por"
NAMES_PLACED = [
    re.compile(rf"(?i:(?<![A-Za-z])(?:{_LATIN_FIELD}))[\"”]?\s{{0,2}}[:=|]\s{{0,2}}[\"“]?({_PERSON})(?=[\"”]?[^\S\n]*(?:[\n;,|.}}]|$))"),
    re.compile(rf"(?:^|(?<=\n))[^\S\n]*(?:-{{2}}|[—–]{{1,2}}|~{{1,2}}|_{{2}})[^\S\n]*\n[^\S\n]*({_PERSON})(?=[^\S\n]*(?:\n|\Z))"),
    re.compile(rf"(?i:(?<![A-Za-z])(?:thanks to|approved by|reviewed by|written by|signed by|confirmed by|reported by|spoke (?:to|with)|talked to|gracias a|aprobado por|firmado por|freigegeben von|geprüft von))\s({_PERSON})(?![\w-])"),
    re.compile(rf"(?<![\w-])({_PERSON})(?=\s(?:signed off|has signed|has approved|approved this|has agreed|said that|told us|wrote to us|hat zugestimmt|hat bestätigt|hat unterschrieben|firmó|confirmó|aprobó)(?!\w))"),
]
#: The cheap test: what one of these patterns needs, in lower case.
PLACED_SIGNS = (
    *_LATIN_FIELD.lower().split("|"), "thanks to", " by ", "spoke ", "talked ", "gracias a", "freigegeben", "geprüft", "aprobado", "firmado", "signed", "approved", "agreed",
    "said that", "told us", "wrote to", "zugestimmt", "bestätigt", "unterschrieben", "firmó", "confirmó", "aprobó", "--", "—", "–", "~", "__",
)
# Two-character surnames, and characters common in given names (besides the rarer ones of GIVEN_CJK).
COMPOUND = "欧阳|司马|上官|诸葛|司徒|东方|皇甫|尉迟|公孙|慕容|令狐|端木|夏侯|长孙|宇文|轩辕|闻人|南宫|独孤|申屠|澹台|钟离|呼延|鲜于|司空|百里|东郭|西门|公羊|赫连"
GIVEN_COMMON = (
    "伟芳娜敏静丽强磊军杰明艳勇洋涛超秀霞平刚桂英华玉兰萍红鹏辉建国飞波斌宇浩凯健俊帆帅旭宁龙林欣雪梅莉琴云洁娟婷玲慧颖琳倩佳嘉怡悦思雨梦瑶琪"
    "晨阳晓小春夏秋冬子梓涵轩泽睿博文武志德荣福庆祥瑞安康永长振兴家贤良忠义仁信诚学海江河山峰岩松柏竹菊荷莲蓉薇萱蕾妍妮婕媛嫣娇燕凤鸿鹤雁莺"
    "昊昕晖晗晟景曦煜炎灿烨焕炜熙钧铭锋锐鑫钰锦银金珍珠珊琦瑾瑜璐璇璟瑛玮珂环碧青蓝紫丹彤彬彦恒恩惠意愿淑清湘洪浩润淳渊源滨潇澄瀚露霏霜雯"
    "露雷震霆卓越远达通进承绍继传启毅坚立成功胜利耀光亮朗宏广大天一元亦亚仪伊佩依俐保冰凌凡凝卫可君吉哲唯善国坤培城堂士奇奕如妙姗姿娅婉宜宗宛"
    "尧岚崇崎川巧希廷弘彪征心忆恬惟懿扬才振捷政敬斯新方旺昂昌易昭晴智曼朋望本权杨杏材林枫栋树桐森楠楚歌正殿民汉沁沛法泉泰洲津流淇渝湛滢澜炳烈"
    "然照爱玄珑琼瑄生画畅白皓皎盈相真睦知石硕祖祯禄禹秉秋童竣筠简素紫红纯纲绮维罡美羽翔翠翰耘聪舒航良艺芝芬芮芸苏苗若茂茜茹荃莎菁菲萌葵蓓蔚蕊"
    "虎行衡裕觉言诗语诺谦豪贵赞超路跃辰辛迅连逸道邦郁里野铁镇长闻阔陆雄雅韵音顺颂风飒馨骏骥高魁鲁麒麟黛鼎齐"
)
# Words that look like a surname with such characters; what a value that is no person ends with; the fields that hold
# a person, and those that may.
NO_NAME = "马上|高峰|高明|高山|高原|高新|高雅|高达|高大|高贵|高远|高清|高亮|方正|方法|方言|方里|江山|江河|石英|马力|马达|马路|金星|金银|黄金|白天|白云|万一|万元|文明|文言|程心|成功|成立|成本|周一|周天|周边|陆路|汪洋|夏天|秋天|江海|和平|安全|安康|文学|文艺|钱币|任意|许可|常规|金山|汤圆|武林|龙虎|龙凤|向上|任一|贺信|毛利|付清|范本|于一|于是|孔明灯"
NO_PERSON = "组队部站号室处司厂店局院台群端库器员们商方科办会班岗"
PERSON_FIELD = "联系人|负责人|作者|经办人|审核人|审批人|提交人|记录人|撰稿人|撰写人|编辑|编者|姓名|署名|签名|签字|申请人|报告人|跟进人|处理人|创建人|发件人|收件人|确认人|对接人|接口人|责任人|值班人|主持人|参会人|译者"
PERSON_FIELD += "|contact|owner|author|reviewer|assignee|reporter|editor|approver|signed by|created by|confirmed by|Ansprechpartner|Verfasser|Autor|Autorin|Bearbeiter|Kontakt|responsable|contacto|revisor|firmado por"
MAY_BE_PERSON_FIELD = "name|nombre|名字|用户|成员"
_SURNAME = rf"(?:{COMPOUND}|[{SURNAMES}])"
_GIVEN_ANY = f"[{GIVEN_CJK}{GIVEN_COMMON}]{{1,2}}"
_FREE = rf"(?!(?:{NO_NAME})(?![一-鿿])){_SURNAME}[一-鿿]{{0,1}}(?![{NO_PERSON}])[一-鿿](?![一-鿿])"  # a value of its own
_AFTER_FIELD = r"[\"”]?(?:\s{0,2}[:：=|]\s{0,2}[\"“]?|\s{1,2})"
NAMES_CJK = [
    re.compile(
        rf"(?:(?<=据)|(?<=由)|(?<=和)|(?<=联系人)|(?<=负责人)|(?<=作者)|(?<=@)|(?<![一-鿿])){_SURNAME}[{GIVEN_CJK}]{{1,2}}(?![{GIVEN_CJK}])"
        rf"|{_SURNAME}[{GIVEN_CJK}]{{1,2}}(?=说，|老师|已经确认|跟进|请)"
        rf"|(?<=据){_SURNAME}[一-鿿]{{1,2}}(?=说[，,])|(?<=由){_SURNAME}[一-鿿]{{1,2}}(?=跟进)|(?<=和){_SURNAME}[一-鿿]{{1,2}}(?=老师)"
        rf"|(?<=@){_SURNAME}[一-鿿]{{1,2}}(?=\s?请)"
    ),
    # Any name as the value of a field, and as a signature.
    re.compile(rf"(?i:(?<![A-Za-z])(?:{PERSON_FIELD}){_AFTER_FIELD}|联系人|负责人)({_FREE})"),
    re.compile(rf"(?i:(?<![A-Za-z])(?:{MAY_BE_PERSON_FIELD})){_AFTER_FIELD}(?!{NO_NAME})({_SURNAME}{_GIVEN_ANY})(?![一-鿿])"),
    re.compile(rf"(?:^|(?<=\n))[^\S\n]*(?:-{{2}}|[—–]{{1,2}}|~{{1,2}}|_{{2}})[^\S\n]*\n?[^\S\n]*({_FREE})(?=[^\S\n]*(?:\n|\Z))"),
    # Any name that is said to have said something; common names before such a word wherever they are.
    re.compile(rf"(?<=[据跟与])(?!{NO_NAME}){_SURNAME}[一-鿿]{{1,2}}?(?=\s?说[，,：:])"),
    re.compile(rf"(?!{NO_NAME}){_SURNAME}{_GIVEN_ANY}(?=\s?(?:说[，,：:]|已经?确认|老师|跟进|请(?![求假示教])))"),
]
NAMES_CJK += [
    # After a person's field that has no sign, and after whom one turns to; and the second of two such.
    re.compile(rf"(?:作者|经办人|审核人|审批人|记录人|报告人|跟进人|责任人|值班人)(?!{NO_NAME})({_SURNAME}{_GIVEN_ANY})(?![一-鿿])"),
    re.compile(rf"(?:联系|请教|转告|通知|询问)[^\S\n]?(?!{NO_NAME})({_SURNAME}{_GIVEN_ANY})(?=[^\S\n]?(?:[或和与及、，。；,;.!！\n]|\Z))"),
    re.compile(rf"(?<=\x00)[^\S\n]?[或和与及、][^\S\n]?(?!{NO_NAME})({_SURNAME}{_GIVEN_ANY})(?=[^\S\n]?(?:[、，。；,;.!！\n]|\Z))"),
]
NAME_CJK = NAMES_CJK[0]
LEADING = " \t\n\xa0:：=|\"“"  # what a field may have between its name and its value
CJK_SIGN = re.compile(rf"[{SURNAMES}][{GIVEN_CJK}]|说[，,：:]|确认|跟进|老师|请|联系|转告|通知|询问|@[一-鿿]|(?:^|\n)[^\S\n]*(?:--|[—–~]|__)|(?i:{PERSON_FIELD}|{MAY_BE_PERSON_FIELD})")


def _replace(text: str, at: list[int] | None, spans: list[tuple[int, int, str]]) -> tuple[str, list[int] | None]:
    """`text` with each span replaced, and the source offset of each of its characters and of its end."""
    if not spans:
        return text, at
    at = list(range(len(text) + 1)) if at is None else at
    out, where, last = [], [], 0
    for start, end, new in spans:
        out += [text[last:start], new]
        where += at[last:start]
        # The last of several characters stands for the end of the span, so that a mention that ends with it covers all of it.
        where += [at[start]] * (len(new) - 1) + [at[end] - 1] if len(new) > 1 else [at[start]] * len(new)
        last = end
    return "".join([*out, text[last:]]), where + at[last:]


def digits(said: str) -> str:
    """The digits of a spelled number; what is said to be double or triple is repeated."""
    out = []
    for m in SPELLED_PART.finditer(said.lower()):
        times = {None: 1, "triple": 3, "treble": 3}.get(m.group(1), 2)
        out.append(DIGIT_WORDS[m.group(2)] * times if m.group(2) else m.group())
    return "".join(out)


def normalise(text: str) -> tuple[str, list[int] | None]:
    """The text without disguises, and the source offset of each character (None where no offset moved)."""
    out = text if text.isascii() else text.translate(ONE_TO_ONE)
    at = None
    if not out.isascii() and INVISIBLE.search(out):
        out, at = _replace(out, at, [(m.start(), m.end(), "") for m in INVISIBLE.finditer(out)])
    if any(x in out for x in "[({<"):  # what AT and DOT begin with
        out, at = _replace(out, at, [(m.start(), m.end(), "@") for m in AT.finditer(out)])
        out, at = _replace(out, at, [(m.start(), m.end(), ".") for m in DOT.finditer(out)])
    low = out.lower()
    if "dot" in low or "punkt" in low or "punto" in low:
        spans = []
        for m in BARE.finditer(out):
            spans.append((m.start(2), m.end(2), "@"))
            spans += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in BARE_DOT.finditer(m.group(3))]
            spans.append((m.start(4), m.end(4), "."))
        out, at = _replace(out, at, spans)
    spelled = [(m.start(), m.end(), digits(m.group())) for m in SPELLED.finditer(out)]
    if "ble" in low or "triple" in low:
        spelled += [(m.start(), m.end(), digits(m.group())) for m in SPELLED_MIXED.finditer(out) if not any(a < m.end() and m.start() < b for a, b, _ in spelled)]
    if not out.isascii():
        spelled += [(m.start(), m.end(), "".join(CJK_DIGITS[c] for c in m.group())) for m in SPELLED_CJK.finditer(out)]
    if spelled:
        out, at = _replace(out, at, sorted(spelled))
    return out, at


def capitalised(text: str) -> str:
    """The text with capitals at the beginnings of words and no others; each character stays one, so that offsets hold."""
    out, inside = [], False
    for c in text:
        new = c.lower() if inside else c.upper()
        out.append(new if len(new) == 1 else c)
        inside = c.isalpha()
    return "".join(out)


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each mention, as offsets into the text itself."""
    if not text:
        return []
    norm, at = normalise(text)
    found: list[tuple[int, int, str]] = []

    def take(kind: str, patterns, work: str) -> str:
        for pattern in patterns:
            spans = [m.span(1) if m.lastindex else (m.end() - len(m.group().lstrip(LEADING)), m.end()) for m in pattern.finditer(work)]
            for a, b in spans:
                found.append((a, b, kind))
                work = work[:a] + "\x00" * (b - a) + work[b:]
        return work

    work = norm
    if "@" in work:
        work = take("email", (EMAIL,), work)
    work = take("idno", (IDNO,), work)
    work = take("phone", (PHONE,), work)
    if SEVEN_DIGITS.search(work):
        work = take("phone", (PHONE_ABROAD, PHONE_SAID), work)
    cased = work if not (work.isupper() or work.islower()) else capitalised(work)
    if ADDRESS_SIGN.search(cased):
        before = len(found)
        cased = take("address", ADDRESS, cased)
        for a, b, _ in found[before:]:
            work = work[:a] + "\x00" * (b - a) + work[b:]
    if cased is not work and (work.isupper() or work.islower()):
        if any(w in GIVEN for w in CAPITAL.findall(cased)):
            work = take("name", (NAME_ANY,), work)
    elif any(w in GIVEN for w in CAPITAL.findall(work)):
        work = take("name", (NAME,), work)
    if ". " in work or "rau " in work or "err" in work:
        work = take("name", (TITLED,), work)
    low = work.lower()
    if any(x in low for x in PLACED_SIGNS):
        work = take("name", NAMES_PLACED, work)
    if not work.isascii() and CJK_SIGN.search(work):
        work = take("name", NAMES_CJK, work)
    if at is not None:
        found = [(at[a], at[b - 1] + 1, kind) for a, b, kind in found]
    return sorted(found)


def redact(text: str | None, found: list[tuple[int, int, str]] | None = None) -> str | None:
    """The text with typed placeholders in place of its mentions; a null text stays null."""
    if not text:
        return text
    out, last = [], 0
    for a, b, kind in mentions(text) if found is None else found:
        if a >= last:
            out += [text[last:a], PLACEHOLDER[kind]]
            last = b
    return "".join([*out, text[last:]])


MENTION = "tbl string, rec_id string, kind string, nth int, start int, stop int"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for tbl, rec, text in zip(*(batch.column(c).to_pylist() for c in ("tbl", "rec_id", "text"))):
            nth = dict.fromkeys(KINDS, 0)
            for a, b, kind in mentions(text):
                nth[kind] += 1
                rows.append((tbl, rec, kind, nth[kind], a, b))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tbl", "rec_id", "kind", "nth", "start", "stop"])


def find(texts: DataFrame) -> DataFrame:
    """Each mention in (tbl, rec_id, text)."""
    named = texts.select("tbl", F.col("rec_id").cast("string").alias("rec_id"), "text")
    return named.mapInArrow(_find, MENTION)


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = [mentions(t) for t in texts]
        clean = pa.array([redact(t, f) for t, f in zip(texts, found)], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("tbl"), batch.column("rec_id"), clean, pa.array([len(f) for f in found], pa.int32())],
            names=["tbl", "rec_id", "redacted", "mentions"],
        )


def redacted(texts: DataFrame) -> DataFrame:
    """(tbl, rec_id, redacted, mentions): every text of (tbl, rec_id, text) with its mentions replaced."""
    named = texts.select("tbl", F.col("rec_id").cast("string").alias("rec_id"), "text")
    return named.mapInArrow(_redact, "tbl string, rec_id string, redacted string, mentions int")
