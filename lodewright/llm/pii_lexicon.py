"""Words that tell what a span of text may be: fixed values, and the words of public tokenizers' vocabularies."""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

#: Vocabularies that say which words are common, and whether in lower case or only capitalised. Never copied into this repository.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """Common words: low are those a vocabulary has in lower case, cap those it has only capitalised; both in lower case."""

    low: frozenset[str]
    cap: frozenset[str]

    def sort_of(self, word: str) -> str:
        """given, ordinary, capital or unknown, for a word in lower case without accents."""
        return "given" if word in GIVEN else "ordinary" if word in self.low or word in CALENDAR or word in CLOSINGS else "capital" if word in self.cap else "unknown"

    def ordinary(self, word: str) -> bool:
        return word not in GIVEN and (word in self.low or word in CALENDAR or word in CLOSINGS)


@lru_cache(maxsize=4)
def vocabulary(paths: tuple[str, ...] = VOCABULARIES) -> Vocabulary:
    """The words that begin a token of one of these vocabularies (ranks in tiktoken's form) after a blank."""
    words: set[str] = set()
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                try:
                    token = base64.b64decode(line.split()[0]).decode()
                except UnicodeDecodeError:
                    continue
                if len(token) > 2 and token[0] == " " and token[1:].isalpha():
                    words.add(token[1:])
    low = frozenset(w for w in words if w.islower())
    return Vocabulary(low, frozenset(w.lower() for w in words if w[0].isupper() and w[1:].islower()) - low)


# Common given names of many languages, in lower case without accents.
GIVEN = set(
    """
    adam agnes ahmed aisha alan albert alejandro alexander ali alice amelie amir ana anders andre andrea andrei angela anita anna antonio anya
    arjun arthur astrid aurora beatriz ben benjamin bernard birgit boris bruno carla carlos carmen catherine cecilia charles charlotte chloe christine claire clara
    daniel david deepa diana diego dmitri dorota edith eduardo elena elias elif elisa elizabeth emil emily emma eric erik esther eva fatima felix fernando fiona
    francesca francois frank george giulia giovanni greta gustav hana hannah hans hassan heidi helen helena henry hiroko hiroshi hugo ian ibrahim ines ingrid irina isabel
    ivan jack jacob jakub james jan jane javier jean jennifer jens joanna joao john jonas jorge jose joseph juan julia jurgen karen karim karin karl kate
    katarzyna kenji kevin liam klaus lars laura lea lena leo linda louis lucas lucia luis magda marco margaret mark luca maria marie mario marta martin mary mateo
    matthew maya mehmet michael miguel mohamed nadia natalia nicolas nils nina noor olga olivia omar oscar oskar otto noah ruben paolo patricia paul paula pavel pedro
    peter petra pierre piotr priya rachel rafael raj ravi richard robert rosa ruth samir samuel sandra sara sarah sergei simon sofia soren stefan stephen susan svetlana
    thomas tomas ulla ursula victor viktor wei william xavier yara yuki yusuf zara zoe
    """.split()
)
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "frau", "herr", "mme", "m", "sr", "sra", "sig", "sir", "dame", "lady", "lord", "professor", "doctor", "señor", "senor", "senora", "madame", "monsieur", "pan", "pani", "doktor", "rev", "capt", "sgt"}
LEADS = GIVEN | {"mr", "mrs", "ms", "dr", "prof", "frau", "herr"}

CALENDAR = set(
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar marz mai juni juli oktober dezember lunes martes miercoles jueves viernes sabado domingo enero febrero "
    "marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
)
# How letters open and close.
CLOSINGS = set("sincerely regards cheers greetings yours best kind warm cordially respectfully thanks thank hello hi hey dear gracias saludos danke grusse gruss hallo merci cordialement bonjour salut atentamente obrigado ciao saluti".split())

NAME_CUES = set(
    "by from to with for and or dear hi hello hey thanks thank cc bcc attn contact ask tell told met meet called named name author owner reviewer reviewed assignee assigned signed "
    "maintainer manager customer patient client tenant applicant employee candidate colleague user person son daughter wife husband per via says said what "
    "von vom an bei fur mit und herrn frau danke lieber liebe name autor de con por para y a gracias hola nombre merci par pour avec et chez nom da di il la com e".split()
)
NAME_FOLLOWS = set(
    "is was has had will would can could did does wrote says said asked told thinks works lives left joined fixed changed merged reported replied called answered signed agreed "
    "suggested approved sent and or who a on at in from the hat ist war wird wohnt schrieb und es fue tiene vive dijo y est a va dit et ha disse".split()
)
PHONE_CUES = set(
    "phone telephone tel call dial mobile cell cellphone fax text sms ring contact reach callback whatsapp signal hotline landline handy mobil telefon telefono anrufen rufnummer durchwahl "
    "movil llamar telefone celular portable telephoner appeler numero number extension pager".split()
)
ID_CUES = set(
    "ssn social security passport licence license driver drivers driving dni nie nif steuer steuernummer idnr tax taxpayer national insurance ni nino id identity identification tin itin cpf cnpj aadhaar aadhar pan pesel bsn "
    "sin curp nir insee codice fiscale fiscal personnummer personalausweis ausweis ausweisnummer reisepass pasaporte passeport passaporto fuhrerschein licencia permis sozialversicherungsnummer "
    "svnr medicare nhs tfn cedula citizen resident rut ahv".split()
)
# What stands before numbers that count or name something else.
NUMBER_CUES = set(
    "build port order row line commit version ticket issue run job page section chapter isbn issn doi invoice account iban bic card size count total bytes ref reference serial part model batch "
    "offset year room flight gate level step test sample item sku lot case code error status checksum hash sha revision release tag trace span request session map byte timestamp epoch "
    "at after before took pid uid port thread worker shard partition index key value box postfach zeile seite bestellung pedido factura fila".split()
)
# Longest alternatives first where one begins another.
STREET_TYPES = {
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "court", "ct", "close", "terrace", "mews", "way", "place", "pl",
    "square", "sq", "crescent", "gardens", "boulevard", "blvd", "grove", "hill", "parkway", "pkwy", "circle", "highway", "hwy", "row", "walk", "quay",
}
ADDRESS_CUES = set("address at to from in office moved lives living live resides located ship deliver delivered send sent mail visit near on bei nach wohnt anschrift adresse direccion vive en domicilio calle indirizzo abita a residente endereco addr home".split())

# Surnames that open a name written without blanks: Chinese, Japanese, Korean; and what follows or precedes a name there.
HAN_SURNAMES = "王李张張刘劉陈陳杨楊赵趙黄黃周吴吳徐孙孫胡朱高林何郭马馬罗羅梁宋郑鄭谢謝韩韓唐冯馮于董萧蕭程曹袁邓鄧许許傅沈曾彭吕呂苏蘇卢盧蒋蔣蔡贾賈丁魏薛叶葉阎閻余潘杜戴夏钟鍾汪田任姜范方石姚谭譚廖邹鄒熊金陆陸郝孔白崔康毛邱秦江史顾顧侯邵孟龙龍万萬段钱錢汤湯"
JAPANESE_SURNAMES = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 斎藤 清水 山崎 阿部 池田 橋本 石川 中島 前田 藤田 後藤 岡田 長谷川 村上 近藤 石井 坂本 遠藤 青木 藤井 西村 福田 太田".split()
HANGUL_SURNAMES = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진나지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁"
HONORIFICS = ("先生", "女士", "小姐", "老师", "同学", "经理", "さん", "様", "氏", "さま", "君", "씨", "님")
HAN_CUES = "叫是给問问由请請跟和与與找到对對：:，,、。；;（(「姓名人者"
