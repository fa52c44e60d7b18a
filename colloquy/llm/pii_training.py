"""Training of the model for personal information, in numpy, from labelled spans.

The labelled rows are made: sentences from a small grammar carry personal items of
many forms and are put into real messages that hold none (``BACKGROUND`` messages of
a dialogues table, a documented bound), with noise of case, typing and fillers. The
grammar, the names and the forms are invented or common knowledge; nothing of them is
taken from a table. Messages serve as background only if no generic sign of an item
is in them (marks, longer numbers, capitalised words that are rare in the table);
halfway, the model itself removes those in which it finds an item.

The table's own wording is learned without labels, by self-training: two models of
different size and seed are fitted to the made rows, and messages in which both find
the same items join the training with these, their values drawn anew half of the time.

Run as ``python -m colloquy.llm.pii_training TABLE OUT [MINUTES]``, minutes for each of
the three fits; the fitted weights lie beside this file. ``HELD_OUT`` has sentences that training never uses, for tests.
"""

from __future__ import annotations

import random
import re
import sys
import time
from collections import Counter

import numpy as np

from colloquy.llm.pii_model import BARRED, KINDS, OTHER, TAGS, Weights, find_spans, padded, symbols

BACKGROUND, WINDOW, BATCH, HIDDEN, KEPT = 16_000, 176, 128, 20, 16

#: Generic signs of an item: at-signs, spelled or long numbers, titles, house numbers before or after a road.
SIGNS = re.compile(
    r"@|\bat\b[\])]|\b(?:dot|punto|punkt|point)\b|(?:\d[ ()/.+-]{0,3}){7}|\d{6}|\d{3}[- ]\d{2,3}[- ]\d{3}|(?:\b(?:oh|zero|one|two|three|four|five|six|seven|eight|nine)\b[ ,-]*){4}"
    r"|\b(?:[Mm]rs?|[Mm]s|[Dd]r|[Pp]rof|[Hh]err|[Ff]rau|[Mm]me|[Ss]ra?)\b\.? |\b[A-Z]\. [A-Z]|\b[A-Z]{2} ?\d|\b[A-Z]\d{5}"
    r"|(?i:\b(?:\d+[a-d]?|(?:num|numm)(?:ber|er)) (?:[\w'-]+ ){0,3}(?:street|st|road|rd|lane|avenue|ave|court|crescent|close|drive|way|terrace|place|square|hill|gardens|row)\b)|(?i:stra(?:ß|ss)e|weg|gasse|platz) \d|(?i:\brue |\bcalle |\bflat \d|\bapt)"
)
RARE = 1e-3

#: The grammar: a choice stands in brackets, a slot in braces. Written without looking at any table.
FRAMES = {
    "en": [
        "[Ring|Dial|Try|Phone] [me|us|my office|the shop|my partner] [on|at|via|with] {phone}[| tonight| before noon| any weekday]{.}", "[Best|Quickest|Easiest] [number|line|contact] [for me |for us |]is {phone}{.}", "[Cell|Mobile|Landline|Tel|Phone|Work]: {phone}",
        "[His|Her|Their|Our] [mobile|work number|landline|extension] [is|reads|should be|was] {phone}[| I believe| last I checked]{.}", "If [nobody answers|it rings out|I miss you], [use|dial|try] {phone}[| or {phone}| instead]{.}", "[Drop|Leave] a voicemail on {phone}{.}",
        "[A message|A text|An SMS] to {phone} [works|is fine|gets through]{.}", "I [changed|switched] from {phone} to {phone}[| last week| recently]{.}", "You [called|dialled|rang] {phone}[|, which is my sister's| by mistake]{.}", "The number [ending the form|shown on the screen|I gave] was {phone}{.}",
        "[Is|Was] {phone} [right|correct|still valid|your mobile]?", "{phone} [is how you get hold of me|is the one to use|would be better|will reach the caretaker]{.}", "[WhatsApp|Viber|Fax] {phone}{.}", "[call|ring] {phone} [and ask for {name}|then speak to {name}]{.}",
        "[Mail|Email|Message|Write] [me|us|the landlord] [at|via|under|on] {email}[| please| whenever you like]{.}", "My [inbox|e-mail|mail|login] is {email}{.}", "[Invoices|Receipts|Statements|The documents] [go|should go|were sent|can go] to {email}{.}", "[Email|Mail|E-mail address]: {email}",
        "[Did|Does] {email} [bounce|work|reach you]?", "I [registered|signed up|logged in] [with|as|using] {email}{.}", "cc {email}[| and {email}]{.}", "The old account used {email}, [the new one|now it] is {email}{.}", "{email} [is spelled correctly|is the one|is mine|belongs to my wife]{.}", "[Attach|Share] it [with|for] {email}{.}",
        "[I am|I'm|It's|This is] {name}[| again| from the second floor| calling back]{.}", "[Speak to|Talk to|Contact|Find] {name} [about it|when you arrive|at reception|first]{.}", "{name} [will open the door|handles our bills|told me so|wrote that down|is my tenant|lives downstairs|answered|agreed]{.}",
        "[My wife|My husband|My neighbour|My tenant|Our caretaker|My mother|The buyer], {name}, [will be home|can sign|knows the code|pays for it]{.}", "The [bill|policy|lease|tenancy|paperwork] [names|lists|shows|mentions] {name}{.}", "[Best|Regards|Cheers|Yours|Sincerely],\n{name}", "- {name}",
        "[Dear|Hi|Hey|Morning|Good evening] {name},", "[Dear|Hi|Hello] {name}[,|!] [how can I help|good to hear from you|one moment]{.}", "[Register|Book|List|Enter] [it|us|the meter] [for|as|under the name] {name}{.}", "[Surname|Name|Full name|Customer name|Tenant]: {name}", "[Did|Has|Will] {name} [sign|reply|agree|call back|pay]?",
        "I [met|saw|asked|trust|emailed|phoned] {name} [yesterday|on Monday|about this|at the fair]{.}", "[That was|It was|Blame|Ask] {name}[, not me| who decided|]{.}", "Thank you, {name}[| for waiting| for your patience]{.}", "[Right|Sure|Okay|Certainly|Of course], {name}[, I can do that|, that works|]{.}", "{name} and {name} [share|own|rent|bought] the [flat|place|house|workshop]{.}",
        "[The owner is|The tenant is|The payer is|It belongs to|I am married to|you want] {name}{.}", "The name on [it|the lease|the letter] [is|was|should read] {name}{.}", "[from|by|for|with|to] {name}[,|] [as agreed|as usual|I think]{.}", "{name}'s [bill|meter|daughter|flat] [is higher|was read|moved out]{.}", "Everyone calls me {name}{.}", "[signed|witnessed|opened|closed|ordered] by {name}{.}",
        "[SSN|Social security|Soc sec no|National insurance|NI number|Tax ID|TIN|Passport|Passport number|ID|ID card|Identity card|Insurance number|Driving licence|Card number|Credit card|Debit card][:| is| =| -] {id_number}{.}",
        "[Take|Debit|Bill|Use] [my card|the Visa|this card|the debit card][|,|:] {id_number}[| until it expires| please|]{.}", "I [hold|carry|renewed|lost] [passport|identity card|ID document] {id_number}{.}", "[To verify me|For verification|As proof|To check who I am][,|:] [I can give|use|here is|take] {id_number}[| as my identity number| from my passport]{.}",
        "[My|His|Her|The tenant's] [passport|identity card|insurance|taxpayer|social|health insurance|payment card] [no|no.|number|code] [is|reads|was|starts and ends like] {id_number}{.}", "{id_number} [is on my passport|is my social|is printed on the card|is my tax number here|stands on my identity card]{.}", "You [asked for|wanted|need] my [ID|social|passport|tax code|insurance number]: {id_number}{.}",
        "[Identity|Person|Citizen|Taxpayer] number {id_number}{.}", "[Pay|Charged|Paid] with {id_number}[|, a credit card|, my bank card]{.}", "the [card|passport|id] {id_number} [expired|was declined|is in my name]{.}",
        "[Send|Mail|Ship|Bring|Drop] [the letter|the box|the kit|the form|it] [to|at|over to] {address}[| by Friday| please|]{.}", "[I|We|My parents|The tenants] [reside|stay|rent|bought] [at|in] {address}[| since May| now|]{.}", "[Home|Address|Delivery address|Billing address|Residence|Property]: {address}", "[Visit|Survey|Inspect|Find us at|Come round to|Knock at] {address}[| tomorrow| after lunch|]{.}",
        "The [flat|meter|property|building|workshop|boiler] [at|in] {address} [is empty|needs a check|was sold|leaks]{.}", "[Our|My|The] [new|old|current|next|second] [place|home|shop|office] [is|was|will be] {address}{.}", "[Is|Was] {address} [connected|on your list|where the van goes|correct]?", "{address} [is where I live|is the one|needs a new meter|has no gas]{.}",
        "From {address} to {address}[| in one week|]{.}", "{name} [of|at|in|from] {address}[ called|]{.}", "{name}, {address}, {phone}", "{name}, {phone}, {email}", "[Contact|Customer]: {name}, {email}", "{name} [has|uses|gave] {phone} and {email}{.}", "{name}, ID {id_number}, {address}", "[Add|Note|Save|Keep] {name} as [a contact|the payer|a backup|our caretaker]{.}", "[This|The account|The line|The meter] [is in the name of|is registered to|was opened for] {name}[, not me|]{.}", "{name}, aged {d2}, {id_number}", "{name} and I [share it|moved in|agreed]{.}", "[a|one] {name} [rang|answered|came by] [yesterday|twice|on Friday]{.}", "[my|our|his] [aunt|boss|agent|doctor|lawyer|grandson|roommate] {name}[| too| again]{.}", "[moving|going|coming] to {address}[| and then to {address}]{.}",
    ],
    "de": ["[Bitte|Sie können] {phone} [wählen|anrufen|nutzen]{.}", "[Handy|Telefon|Festnetz]: {phone}", "[Schreiben Sie|Bitte schreiben] an {email}{.}", "E-Mail: {email}", "[Hier ist|Hier spricht|Ich bin] {name}{.}", "[Frau|Herr] und Nachbar {name} [weiß|kennt] das{.}", "Der Vertrag [läuft|steht] auf {name}{.}", "[Unsere Anschrift|Die Adresse|Das Haus] [ist|lautet] {address}{.}", "[Schicken|Senden] Sie es [an|nach] {address}{.}", "[Pass|Personalausweis|Steuernummer|Karte|Versicherung]: {id_number}", "Die Nummer [im Pass|meines Ausweises|der Karte|meiner Versicherung] lautet {id_number}{.}", "[Guten Tag|Hallo|Danke], {name}{.}", "[erreichbar|zu erreichen] unter {phone}{.}"],
    "fr": ["[Appelez|Rappelez|Joignez]-moi au {phone}{.}", "[Portable|Tél|Téléphone] : {phone}", "[Écrivez|Envoyez-le] à {email}{.}", "Courriel : {email}", "[Ici|C'est|Je suis] {name}{.}", "Le contrat est au nom de {name}{.}", "[Nous habitons|Je demeure|On loge] [au|à] {address}{.}", "[L'adresse|Le logement] est {address}{.}", "[Passeport|Carte|Numéro fiscal|Sécurité sociale] : {id_number}", "Mon [passeport|numéro de carte|numéro fiscal] est {id_number}{.}", "[Bonjour|Merci|Salut] {name}{.}", "{name} [est ma voisine|paie la facture]{.}"],
    "es": ["[Llámeme|Marque|Pruebe] al {phone}{.}", "[Móvil|Teléfono|Tel]: {phone}", "[Escriba|Mándelo] a {email}{.}", "Correo: {email}", "[Soy|Aquí|Habla] {name}{.}", "El contrato está a nombre de {name}{.}", "[Vivimos|Resido|Estamos] en {address}{.}", "[La dirección|El piso] es {address}{.}", "[Pasaporte|DNI|Tarjeta|Número fiscal]: {id_number}", "Mi [pasaporte|tarjeta|número de identidad] es {id_number}{.}", "[Hola|Gracias|Buenos días], {name}{.}", "{name} [paga la luz|es mi vecina]{.}"],
}
#: Sentences that look alike but carry no personal item.
TRAPS = [
    "[Ticket|Case|Order|Parcel|Booking|Claim|Incident|Contract] [no |number |#|]{n}[| was closed| is pending| came twice]{.}", "[Bill|Invoice|Receipt|Statement] {n} [of|from|dated] {date}{.}", "[Meter|Serial|Device|Router|Point] [number|no|id|serial] [is |]{n}{.}", "The [meter|display|counter|dial] [shows|showed|says|reads] {n}[| units| kWh| today]{.}", "[Offer|Voucher|Promo|Discount|Tariff] [code|number] {n}{.}", "My reading [is|was] {n}[| this month| on {date}]{.}", "[Deadline|Due date|Valid until|Starts|Ends|Date|Appointment|Delivery]: {date}", "[Remember|Note|Save|Write down|Keep] [the|this] [date|day|deadline][:|,] {date}{.}", "[Invoice|Bill|Statement|Reminder|Payment|Account] {n} [is|was|went|had been|will be] [due|late|paid|wrong|corrected|refunded][| in {month}| last week| in {month} 20{d2}]{.}", "[The|Your|My] [offer|voucher|contract|quote|promotion|gift|access] [code|key|number|reference] [is|was|reads] {n}{.}", "[Due|Paid|Booked|Signed|Read] on {date}{.}",
    "[On|By|Since|Before] {date}[,|] [we had none|nothing changed|it rose]{.}", "[It costs|They charge|We paid|I owe] {d2}.{d2} [a month|per unit|each quarter|in total]{.}", "Between {d4} and {d4} [kWh|units][| a year]{.}", "[Page|Section|Step|Line] {d2} [of {d2}|is unclear]{.}", "[Room|Gate|Platform|Desk|Bus] {d2} [is closed|at noon]{.}", "In 20{d2} [it was|we paid] {d3}{.}", "{d1} [hours|days|miles|rooms] [later|away|left]{.}", "Version {d1}.{d1}.{d2} [crashes|is out]{.}", "see you @ the [fair|office|booth] at {d1}{.}",
    "[They closed|Works in|Cables under|A shop on|Traffic in|We walked along|The office off|Noise from] {road}[| last year| again|]{.}", "[Which|What] [road|street|avenue] [was it|is that]?", "{road} [has|had] {d2} [shops|houses|lamps]{.}", "It is {d2} [minutes|metres|miles|yards] [from|to|past|off] {road}{.}", "[We drove|I walked|They cycled] {d2} [miles|minutes|blocks] to [the office|a showroom|the depot|a house] [off|near|on|by] {road}{.}",
    "{firm} [is cheaper|replied|called me twice|raised the price|serves us|put up the rate]{.}", "[I left|I joined|I prefer|I asked|I am with|We chose|Compare it with] {firm}[| last year|]{.}", "Is {firm} [bigger|better|cheaper] than {firm}?", "[The|My|Your|Our] {product} [plan|tariff|deal|option|label|bundle] [ends|is dear|suits us|starts]{.}", "[Is|Would] {product} [cheaper|better|right for me]?", "[Switch|Move|Go] [to|from] {product}[| to {product}]{.}", "{product} or {product}, which one?",
    "[We are|They live|My son works|It rains|A branch|A garage|The depot] [in|near|outside|around] {W}{.}", "[In|Near|Around] {W} [prices|bills|rates] [rose|fell]{.}", "Does {firm} [serve|cover|supply] {W}?", "[Monday|Tuesday|Friday|Saturday], [May|June|March|October] [or|and] [April|Easter|Christmas]{.}", "[The] [billing|renewals|support|meter] [team|desk|people] [will call|wrote|agreed]{.}", "[I live|We live|He stays] [upstairs|abroad|with friends|in a flat|by the sea]{.}", "[Call|Ring|Write] [me|us] [later|on Friday|tomorrow|at nine]{.}",
    "[My|The|Your] [name|address|number|email|passport] is [on file|wrong|missing|not listed|private]{.}", "[She|He|My boss|The owner|The council|My landlord] [signed|agreed|pays|called|knows]{.}", "[Thanks|Thank you|Okay|Great|Well|Right], [that helps|noted|understood|bye|good to know|sure]{.}", "[This is|It is|I am] [annoying|late|the manager|fine|her brother|a supplier]{.}", "[Hi|Hello|Good morning|Dear] [there|team|all|customer|sir],", "[Bitte warten|Vielen Dank|Der Strom ist teuer|Merci beaucoup|La facture est chère|Muchas gracias|La luz es cara|Guten Morgen]{.}",
]
#: Sentences that training never uses.
HELD_OUT = {
    "en": [
        "You will catch me fastest through {phone}.", "Could the fitter give {phone} a buzz beforehand?", "Our switchboard, {phone}, opens at eight.", "Whoever picks up {phone} can take the details.", "Kindly direct the summary towards {email}.", "The confirmation never arrived in {email}, sadly.", "Anything urgent belongs in {email} rather than in the post.", "Use whichever of {email} and {email} you prefer.",
        "Only {name} has the key to the cellar.", "Would {name} mind checking the boiler?", "We let the upper floor to {name} in spring.", "Kind of you to ask, {name}, everything is settled.", "According to {name} the deposit was returned.", "As {name} explained, the heating failed.", "The van goes round to {address} this afternoon.", "Nobody has been inside {address} for a year.", "Deliveries for {address} end up next door.", "Our old cottage, {address}, still gets your letters.",
        "Border control noted {id_number} from my passport.", "The pension office files me under {id_number}.", "Please keep {id_number} secret, it is my bank card.", "They matched my identity card {id_number} against the list.",
    ],
}
#: Common given names and surnames beside invented ones.
GIVEN = "Anna Ben Clara David Emma Felix Grace Hugo Ivy Jack Karen Liam Maria Nina Oscar Paula Quentin Rosa Samuel Tara Ulrich Vera Walter Yusuf Zoe Ahmed Aisha Chen Diego Elif Fatima Giulia Hans Ingrid Jean Kofi Leila Mateo Noah Olga Pierre Priya Rahul Sofia Tomas Wei Yuki Amelie Bruno Carmen".split()
FAMILY = "Smith Jones Brown Miller Taylor Wilson Clark Walker Hall Young King Baker Hill Green Cook Bell Ward Reed Gray Stone Meyer Weber Fischer Wagner Becker Schulz Klein Wolf Dubois Moreau Laurent Girard Garcia Lopez Perez Ruiz Romero Torres Rossi Ricci Jansen Visser Novak Kowalski Ivanov Nguyen Patel Khan Singh Tanaka".split()
FIRST = "ab el ni ka ro mi lu ta jo ve sa du pe or fa ri ho len an na is ra do mar bri th y e a o i".split()
LAST = "bar dun mor kel ash wick ton field vik sen ova berg ros hall man stein lund ric dor gren wald quist mere ley row ings by ham ford lock er well worth el in ar os ett ow all ill".split()
PLACE = "north south east wood brook stone green fair high low mill oak elm ash red fern clay thorn haven dale port ford moor marsh gate field ton bury ham wick ley mere cliff bridge hollow low".split()
ROADS = "Street Road Lane Avenue Court Crescent Close Drive Way Terrace St St. Rd Rd. Ave Ave. Place Square Hill Gardens Row Walk Mews Grove Park Lane Street Road".split()
FIRMS = "Energy Power Gas Electric Supply Utilities Water Light Heat Renewables Solar Grid Networks Group Ltd Services".split()
ADJECTIVES = "Green Smart Night Day Easy Fair Fixed Flex Bright Simple Blue Clear Home Solar Super Prime Value Eco Open Early".split()
GOODS = "Saver Plus Plan Tariff Deal Basic Max Owl Flow Rate Choice Start Path Time Care Max Fix Zero Light Standard".split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety".split()
DIGIT_WORDS = "oh zero one two three four five six seven eight nine".split()
MONTHS = "January February March April May June July August September October November December".split()
FILLERS = "maybe,really,frankly,usually,you know,by the way,roughly,thing,matter,like,well,actually".split(",")


_INSIDE = re.compile(r"(?<=[\w,;:] )[A-Z][^\W\d_]+")


class Signs:
    """Tells the messages with a generic sign of an item: those of ``SIGNS``, and capitalised words inside a sentence that few messages of the table have."""

    def __init__(self, messages: list[str], rare: float = RARE) -> None:
        self.counts = Counter(w for m in messages for w in set(_INSIDE.findall(m)))
        self.least = max(3, rare * len(messages))

    def rare(self, message: str) -> bool:
        return any(self.counts[w] < self.least for w in _INSIDE.findall(message))

    def __call__(self, message: str) -> bool:
        return bool(SIGNS.search(message)) or self.rare(message)


class Maker:
    """Draws labelled messages."""

    def __init__(self, messages: list[str], seed: int = 7, frames: dict[str, list[str]] = FRAMES, bound: int = BACKGROUND) -> None:
        self.r, self.frames = random.Random(seed), frames
        self.signs = Signs(messages)
        clean = [m for m in messages if not self.signs(m)]
        self.r.shuffle(clean)
        self.use(clean[:bound])
        self.found: list[tuple[str, list[tuple[int, int, str]]]] = []  # messages with the items that models agree on

    def use(self, clean: list[str]) -> None:
        self.clean = clean
        self.short = [m for m in clean if len(m) < 40][:2000]
        self.foreign = [m for m in clean if self.language(m) != "en"]

    @staticmethod
    def language(text: str) -> str:
        counts = {code: len(re.findall(words, text)) for code, words in (("de", r"\b(?:und|nicht|Sie|ist|der)\b"), ("fr", r"\b(?:vous|nous|est|les|pour)\b"), ("es", r"\b(?:que|usted|con|los|para)\b"))}
        best = max(counts, key=counts.get)
        return best if counts[best] > 1 else "en"

    def pick(self, *options):
        return self.r.choice(options)

    def digits(self, pattern: str) -> str:
        return "".join(str(self.r.randrange(10)) if c == "#" else c for c in pattern)

    def invented(self, parts: list[str], low: int = 2, high: int = 3) -> str:
        return "".join(self.r.choice(parts) for _ in range(self.r.randint(low, high))).capitalize()

    def given(self) -> str:
        return self.r.choice(GIVEN) if self.r.random() < 0.3 else self.invented(FIRST)

    def surname(self) -> str:
        own = self.r.choice(FAMILY) if self.r.random() < 0.25 else self.invented(FIRST + LAST + LAST, 2, 4)
        if self.r.random() < 0.12:
            own = self.pick("van der ", "de la ", "von ", "O'", "Mc", "di ", "Mac", "de ", "van ", "El-") + own
        if self.r.random() < 0.06:
            own += "-" + self.invented(LAST)
        return own

    def name(self) -> str:
        first, last = self.given(), self.surname()
        initial = self.r.choice("ABCDEFGHIJKLMNOPRSTVWZ") + "."
        roll = self.r.random()
        if roll < 0.48:
            return f"{first} {last}"
        if roll < 0.6:
            return f"{first} {initial} {last}"
        if roll < 0.72:
            return f"{initial} {last}"
        if roll < 0.87:
            return f"{self.pick('Mr', 'Mrs', 'Ms', 'Dr', 'Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'Herr', 'Frau', 'Mme', 'Señora', 'Miss')} {last}"
        return first if roll < 0.96 else last

    def email(self) -> str:
        first, last = (re.sub(r"\W", "", x).lower() for x in (self.given(), self.surname()))
        mark = self.pick(".", "_", "-", "", ".")
        local = self.pick(f"{first}{mark}{last}", f"{last}{mark}{first}", f"{first[0]}{mark}{last}", f"{last}{self.digits(self.pick('#', '##', '###', '####'))}", f"{first}{self.digits('##')}", f"{first}{mark}{last}+{self.pick('home', 'bills', 'shop', 'news')}", first, f"{last}.{first}{self.digits('#')}", self.pick("info", "office", "kontakt", "mail"))
        domain = f"{self.pick('example', 'mail.example', 'post', 'home', 'office', self.invented(FIRST + LAST).lower(), self.invented(PLACE).lower())}.{self.pick('com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io', 'example', 'test', 'invalid', 'info')}"
        roll = self.r.random()
        at, dot = (("@", ".") if roll < 0.6 else self.pick(("[at]", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "(dot)")) if roll < 0.8 else (" at ", " dot ") if roll < 0.92 else (" @ ", "."))
        out = f"{local}{at}{domain.replace('.', dot)}"
        if self.r.random() < 0.08:
            out = f"<{out}>"
        return out.upper() if self.r.random() < 0.05 else out

    def phone(self) -> str:
        """Digits in groups, with or without codes and extension, or spelled."""
        if self.r.random() < 0.14:
            word = self.r.choice(DIGIT_WORDS)
            start = [word] * self.pick(1, 1, 2, 3)
            return " ".join(start + [self.r.choice(DIGIT_WORDS) for _ in range(self.r.randint(7, 10) - len(start))])
        mark = self.pick(" ", " ", "-", "-", ".", " / ", "")
        groups = self.pick("### ### ####", "### ### ####", "### ### ####", "### #### ####", "#### ######", "##### ######", "## ## ## ## ##", "### ### ###", "## #### ####", "### ## ## ##", "## ##### ###", "#### ### ###").split()
        groups[0] = "0" + groups[0][1:] if self.r.random() < 0.35 else groups[0]
        out = mark.join(groups)
        if self.r.random() < 0.25:
            out = f"({groups[0]}) " + (mark.strip() or " ").join(groups[1:])
        if self.r.random() < 0.3:
            groups[0] = groups[0].lstrip("0") or "#"
            code = self.pick("+#", "+##", "+##", "00##", "+1", "+44", "+49", "+33", "+34")
            out = code + (mark.strip(" /") or self.pick(" ", " ", "")) + (mark.strip(" /") or " ").join(groups)
        return self.digits(out + (self.pick(" ext. ", " ext ", " x") + "##" if self.r.random() < 0.07 else ""))

    def id_number(self) -> str:
        """Card numbers, social security, insurance, passport, identity card and tax numbers by their public formats."""
        mark = self.pick("-", " ", "", "-", " ")
        form = self.pick(mark.join(["####"] * 4), mark.join(["####"] * 4), mark.join(("####", "######", "#####")), "###-##-####", "###-##-####", mark.join(("###", "##", "####")) if mark else "###-##-####", mark.join(("LL", "##", "##", "##", "L")) if mark != "-" else "LL######L", "LL######L", "LL ## ## ## L", "LL#######", "L########", "L#######", "L##L####", "L####L###", "LLL######", "##########L", "########L", "## ### ### ###", "###########", "##/###/#####", "#########")
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVXYZ") if c == "L" else str(self.r.randrange(10)) if c == "#" else c for c in form)

    def road(self) -> str:
        own = self.invented(PLACE + FIRST + LAST, 2, 3) if self.r.random() < 0.7 else self.pick("Station", "Church", "Park", "Victoria", "Queen", "Orchard", "Chapel", "Garden", "Bridge", "Market", "School", "Harbour")
        if self.r.random() < 0.25:
            own = self.pick("Old ", "Upper ", "Lower ", "Great ", "New ", "North ", "Little ", "St. ", "Long ") + own
        return own + " " + self.r.choice(ROADS)

    def address(self) -> str:
        road, number, town = self.road(), self.digits(self.pick("#", "##", "###")) + self.pick("", "", "", self.r.choice("abcdABC"), "-" + str(self.r.randrange(9))), self.invented(PLACE)
        roll = self.r.random()
        if roll < 0.3:
            return f"{number} {road}, {town}" + (f", {self.digits('#####')}" if roll < 0.03 else "")
        if roll < 0.4:
            return f"{number} {road} in {town}"
        if roll < 0.54:
            return f"{number} {road}"
        if roll < 0.62:
            return f"{number} {road}, {self.pick('Apt', 'Apartment', 'Unit', 'Apt.', 'Suite')} {self.digits('##')}{self.pick('', self.r.choice('ABCD'))}"
        if roll < 0.74:
            comma = self.pick(", ", ", ", ", ", "\n")
            return comma.join((f"{self.pick('Flat', 'Flat', 'Unit', 'Apartment')} {self.digits(self.pick('#', '##'))}", f"{number} {road}", town)[: self.pick(2, 3, 3)])
        if roll < 0.82:
            tens = self.r.choice(NUMBERS)
            return f"number {tens}{self.pick('', '', '-' + self.r.choice(NUMBERS[:9]))}{self.pick(', ', ' ')}{road}"
        own = self.invented(PLACE + LAST)
        if roll < 0.9:
            return f"{own}{self.pick('weg', 'straße', 'gasse', 'platz', 'str.', 'strasse', 'allee')} {number}" + (f", {self.digits('#####')} {town}" if roll < 0.84 else "")
        if roll < 0.96:
            return f"{number}{self.pick(' ', ' ', ', ')}{self.pick('rue', 'avenue', 'place', 'chemin', 'boulevard')} {self.pick('de la ', 'du ', 'de ', 'des ', '')}{own}"
        return f"{self.pick('Calle', 'Avenida', 'Plaza', 'calle')} {own}{self.pick(' ', ', ')}{number}"

    def number(self) -> str:
        """Numbers of bills, meters, tickets, offers and readings."""
        form = self.pick("####", "#####", "######", "########", "####-####", "###-##-####", "LL-#####", "L#####", "LL####", "#### ####", "##L-###-####", "### ####", "##/####", "L-#### #", "#############", "LLL-###", "### ###", "#########", "L####-##")
        return "".join(self.r.choice("ABCDEFGHKLMNPRSTVX") if c == "L" else str(self.r.randrange(10)) if c == "#" else c for c in form)

    def filler(self, slot: str) -> str:
        if slot[0] == "d" and slot[1:].isdigit():
            return self.digits("#" * int(slot[1]))
        return {
            "month": lambda: self.r.choice(MONTHS), "n": self.number, "road": self.road, "W": lambda: self.pick("", "", "Upper ", "Old ", "North ") + self.invented(PLACE), "firm": lambda: self.invented(PLACE + LAST) + (" " + self.r.choice(FIRMS) if self.r.random() < 0.8 else ""),
            "product": lambda: self.pick(self.r.choice(ADJECTIVES) + " " + self.r.choice(GOODS), self.r.choice(ADJECTIVES) + self.r.choice(GOODS).lower(), self.invented(PLACE) + " " + self.r.choice(GOODS)) + self.pick("", "", " " + self.digits("##")),
            "date": lambda: self.pick(f"{self.r.choice(MONTHS)} {self.digits('#')}", f"{self.digits('##')}-{self.digits('##')}-20{self.digits('##')}", f"{self.digits('##')}/{self.digits('##')}/{self.digits('##')}", f"{self.digits('##')}.{self.digits('##')}.20{self.digits('##')}", f"{self.digits('#')} {self.r.choice(MONTHS)} 20{self.digits('##')}"),
        }[slot]()

    def spread(self, text: str) -> str:
        """Draws the choices of a sentence."""
        while "[" in text and "]" in text and "|" in text:
            done = re.sub(r"\[([^\[\]]*\|[^\[\]]*)\]", lambda m: self.r.choice(m[1].split("|")), text)
            if done == text:
                break
            text = done
        return text.replace("{.}", self.pick(".", ".", ".", "", "!", ",", ";"))

    def courtesy(self) -> str:
        return self.pick("Okay", "Alright", "Good", "Great", "Right", "Sure", "Yes", "No", "Well", "Fine", "Perfect", "Understood", "Thanks", "Hello", "Hi", "Danke", "Merci", "Gracias") + self.pick(", thanks.", ", that helps.", " to know.", ".", "!", ", I see.", " then.", ", good morning.", "")

    def sentence(self, language: str) -> list[tuple[str, int]]:
        """Pieces of text with their kind (-1 outside)."""
        if self.r.random() < 0.3:
            text = self.spread(self.r.choice(TRAPS))
            return [(re.sub(r"\{(\w+)\}", lambda m: self.filler(m[1]), text), -1)]
        frames = self.frames[language] if language in self.frames and self.r.random() < 0.8 else self.frames["en"]
        pieces = []
        for part in re.split(r"(\{\w+\})", self.spread(self.r.choice(frames))):
            kind = part[1:-1]
            if part[:1] == "{" and kind in KINDS:
                pieces.append((getattr(self, kind)(), KINDS.index(kind)))
            elif part[:1] == "{":
                pieces.append((self.filler(kind), -1))
            elif part:
                pieces.append((part, -1))
        return pieces

    def found_message(self) -> tuple[str, np.ndarray]:
        """A message that models agree on; half of its values are drawn anew."""
        own, spans = self.r.choice(self.found)
        text, tags, at = [], [], 0
        for first, end, kind in spans:
            value = getattr(self, kind)() if self.r.random() < 0.5 else own[first:end]
            text += [own[at:first], value]
            tags += [0] * (first - at) + [1 + 2 * KINDS.index(kind)] + [2 + 2 * KINDS.index(kind)] * (len(value) - 1)
            at = end
        return "".join(text) + own[at:], np.array(tags + [0] * (len(own) - at), np.int8)

    def message(self) -> tuple[str, np.ndarray]:
        """A text with a tag per character."""
        if self.found and self.r.random() < 0.3:
            return self.found_message()
        roll = self.r.random()
        pool = self.short if self.short and roll < 0.08 else self.foreign if self.foreign and roll < 0.28 else self.clean
        base = self.r.choice(pool) if pool else "Thank you. Good to know."
        language = self.language(base)
        parts = [[(s, -1)] for s in re.split(r"(?<=[.?!])\s+", base)]
        if self.r.random() < 0.08:
            parts = [[(self.courtesy(), -1)]] + parts[: self.r.randint(0, 2)]
        if self.r.random() < 0.3:
            parts = parts[: self.r.randint(0, len(parts))]
        for _ in range(self.r.choice((0, 0, 1, 1, 1, 2, 3))):
            parts.insert(self.r.randint(0, len(parts)), self.sentence(language))
        pieces = [p for k, s in enumerate(parts) for p in ([(self.pick(" ", " ", " ", "\n"), -1)] if k else []) + s]
        if not pieces:
            pieces = self.sentence("en")
        shape = self.r.random()
        noisy = self.r.random() < 0.15
        text, tags = [], []
        for value, kind in pieces:
            if kind == 4 and self.r.random() < 0.06:
                value = value.lower()
            value = value.lower() if shape < 0.1 else value.upper() if shape < 0.13 else value
            if noisy and kind < 0:
                value = self.noise(value)
            text.append(value)
            tags += [0] * len(value) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(value) - 1)
        return "".join(text), np.array(tags, np.int8)

    def noise(self, value: str) -> str:
        out = []
        for word in re.split(r"( )", value):
            roll = self.r.random()
            if roll < 0.03 and len(word) > 2:
                k = self.r.randrange(len(word) - 1)
                word = self.pick(word[:k] + word[k + 1 :], word[:k] + word[k] + word[k:], word[:k] + word[k + 1] + word[k] + word[k + 2 :])
            elif roll < 0.05 and word.strip():
                word = word + " " + self.r.choice(FILLERS)
            elif roll < 0.06:
                word = " " if word == " " else ""
            out.append(word)
        return "".join(out)


def batch_of(maker: Maker, size: int = BATCH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded symbols, tags and lengths; of a longer message a random stretch."""
    rows = []
    for _ in range(size):
        text, tags = maker.message()
        own = symbols(text)
        at = maker.r.randint(0, max(0, len(own) - window))
        own, tags = own[at : at + window], tags[at : at + window].copy()
        if len(tags) and tags[0] and tags[0] % 2 == 0:
            tags[0] -= 1  # an item cut by the edge begins there
        rows.append((own, tags))
    lengths = np.array([max(1, len(x)) for x, _ in rows])
    data = np.zeros((size, int(lengths.max())), np.uint8)
    truth = np.zeros_like(data, np.int64)
    for i, (own, tags) in enumerate(rows):
        data[i, : len(own)], truth[i, : len(own)] = own, tags
    return data, truth, lengths


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf(weights: Weights, scores: np.ndarray, truth: np.ndarray, lengths: np.ndarray):
    """Loss per character and the gradients of scores, transitions and start."""
    # In double precision: the sums over a window are large, and rounding would push the scores one way.
    scores = scores.astype(np.float64)
    count, time, _ = scores.shape
    step = weights.transitions.astype(np.float64) + BARRED
    first = weights.start.astype(np.float64) + BARRED[0]
    rows = np.arange(count)
    alpha = np.empty_like(scores)
    alpha[:, 0] = scores[:, 0] + first
    for t in range(1, time):
        alpha[:, t] = scores[:, t] + log_sum(alpha[:, t - 1][:, :, None] + step, 1)
    total = log_sum(alpha[rows, lengths - 1], 1)
    beta = np.zeros_like(scores)
    d_step = np.zeros_like(step)
    for t in range(time - 2, -1, -1):
        ahead = scores[:, t + 1] + beta[:, t + 1]
        inside = (t + 1 < lengths)[:, None]
        beta[:, t] = np.where(inside, log_sum(step[None] + ahead[:, None, :], 2), 0)
        pair = np.exp(np.minimum(alpha[:, t][:, :, None] + step + ahead[:, None, :] - total[:, None, None], 0)) * inside[:, :, None]
        d_step += pair.sum(axis=0)
    live = np.arange(time) < lengths[:, None]
    d_scores = np.exp(np.minimum(alpha + beta - total[:, None, None], 0)) * live[:, :, None]
    d_first = d_scores[:, 0].sum(axis=0)
    score = (np.take_along_axis(scores, truth[:, :, None], 2)[:, :, 0] * live).sum() + first[truth[:, 0]].sum()
    pairs = live[:, 1:]
    score += (step[truth[:, :-1], truth[:, 1:]] * pairs).sum()
    np.add.at(d_step, (truth[:, :-1][pairs], truth[:, 1:][pairs]), -1)
    np.add.at(d_first, truth[:, 0], -1)
    d_scores[rows[:, None], np.arange(time), truth] -= live
    size = live.sum()
    return (total.sum() - score) / size, d_scores / size, d_step / size, d_first / size


def gradients(weights: Weights, data: np.ndarray, truth: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Forward pass, CRF loss, and back through time."""
    hidden, (count, time) = weights.hidden, data.shape
    place = np.arange(time)
    backward = np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place)
    streams = np.stack([data, np.take_along_axis(data, backward, 1)]).transpose(2, 0, 1)
    inputs = weights.inputs
    state, cell = np.zeros((2, count, hidden), np.float32), np.zeros((2, count, hidden), np.float32)
    trail = []
    for t in range(time):
        raw = state @ weights.recurrent
        raw[0] += inputs[0][streams[t, 0]]
        raw[1] += inputs[1][streams[t, 1]]
        let, keep, show = (sigmoid(raw[..., k * hidden : (k + 1) * hidden]) for k in range(3))
        new = np.tanh(raw[..., 3 * hidden :])
        before, last = cell, state
        cell = keep * cell + let * new
        bent = np.tanh(cell)
        state = show * bent
        trail.append((let, keep, show, new, before, last, bent, state))
    states = np.stack([x[7] for x in trail])  # time, direction, window, hidden
    joined = np.concatenate([states[:, 0].transpose(1, 0, 2), np.take_along_axis(states[:, 1].transpose(1, 0, 2), backward[:, :, None], 1)], axis=2)
    loss, d_scores, d_step, d_first = crf(weights, joined @ weights.out + weights.bias, truth, lengths)
    d_scores = d_scores.astype(np.float32)
    grads = {"out": np.einsum("bth,btk->hk", joined, d_scores, optimize=True), "bias": d_scores.sum((0, 1)), "transitions": d_step, "start": d_first}
    d_joined = d_scores @ weights.out.T
    d_states = np.stack([d_joined[:, :, :hidden], np.take_along_axis(d_joined[:, :, hidden:], backward[:, :, None], 1)]).transpose(2, 0, 1, 3)
    d_inputs, d_recurrent = np.zeros_like(inputs), np.zeros_like(weights.recurrent)
    d_state, d_cell = np.zeros((2, count, hidden), np.float32), np.zeros((2, count, hidden), np.float32)
    eye = np.eye(OTHER + 1, dtype=np.float32)
    for t in reversed(range(time)):
        let, keep, show, new, before, last, bent, _ = trail[t]
        d_state = d_state + d_states[t]
        d_cell = d_cell + d_state * show * (1 - bent * bent)
        d_raw = np.concatenate([d_cell * new * let * (1 - let), d_cell * before * keep * (1 - keep), d_state * bent * show * (1 - show), d_cell * let * (1 - new * new)], axis=2)
        d_recurrent += last.transpose(0, 2, 1) @ d_raw
        for k in range(2):
            d_inputs[k] += eye[streams[t, k]].T @ d_raw[k]
        d_state = d_raw @ weights.recurrent.transpose(0, 2, 1)
        d_cell = d_cell * keep
    whole = {"embed": np.einsum("dsg,deg->se", d_inputs, weights.project), "project": weights.embed.T @ d_inputs, "shift": d_inputs.sum(axis=1)}
    return float(loss), grads | whole | {"recurrent": d_recurrent}


def without_items(weights: Weights, messages: list[str]) -> list[str]:
    """The messages in which the model finds nothing."""
    weights.packed = weights.stepper = None
    return [m for m, spans in zip(messages, find_spans(weights, messages)) if not spans]


def agreed(models: list[Weights], messages: list[str], signs: Signs | None = None) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], list[str]]:
    """Messages with the items that all models find in them, and messages in which none finds any; what is left of either may hold no sign of a further item."""
    signs = signs or Signs(messages)
    found, clean = [], []
    for message, spans, *others in zip(messages, *(find_spans(w, messages) for w in models)):
        left, at = [], 0
        for first, end, _ in spans:
            left.append(message[at:first])
            at = end
        if all(o == spans for o in others) and not signs("it".join([*left, message[at:]])):
            found.append((message, spans)) if spans else clean.append(message)
    return plausible(found, messages), clean


def plausible(found: list[tuple[str, list[tuple[int, int, str]]]], messages: list[str], least: float = 0.2) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Without messages in which a name consists of words that stand outside of names nearly everywhere in the table."""
    names = [[re.findall(r"\w+", message[a:b].lower()) for a, b, kind in spans if kind == "name"] for message, spans in found]
    inside = Counter(w for own in names for words in own for w in words)
    whole = Counter(w for m in messages for w in re.findall(r"\w+", m.lower()) if w in inside)
    common = {w for w, n in inside.items() if n < least * whole[w]}
    return [one for one, own in zip(found, names) if not any(words and common.issuperset(words) for words in own)]


def fit(messages: list[str], minutes: float, seed: int = 7, hidden: int = HIDDEN, rate: float = 0.006, start: Weights | None = None, models: list[Weights] | None = None, say=print) -> Weights:
    """Adam with a falling rate until the time is over; halfway the background is chosen anew, by the model.

    With ``models`` the messages they agree on are used from the start.
    """
    maker, weights = Maker(messages, seed), start or Weights.fresh(hidden, seed)
    if models:
        maker.found, clean = agreed(models, messages, maker.signs)
        maker.r.shuffle(clean)
        maker.use(clean[:BACKGROUND])
    say(f"{len(maker.found)} messages with items;",f"{len(maker.clean)} of {len(messages)} messages as background", flush=True)
    moments = {n: (np.zeros_like(getattr(weights, n)), np.zeros_like(getattr(weights, n))) for n in Weights.NAMES}
    began, steps, mean, chosen = time.time(), 0, 0.0, bool(models)
    while (done := (time.time() - began) / (60 * minutes)) < 1:
        if done > 0.5 and not chosen:
            chosen = True
            pool = maker.clean + [m for m in messages if maker.signs.rare(m) and not SIGNS.search(m)]
            maker.r.shuffle(pool)
            maker.use(without_items(weights, pool[: 2 * BACKGROUND])[:BACKGROUND])
            say(f"{len(maker.clean)} messages as background", flush=True)
        loss, grads = gradients(weights, *batch_of(maker))
        steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        pace = rate * min(1.0, steps / 50) * (0.5 * (1 + np.cos(np.pi * done)) + 0.005)
        for name, grad in grads.items():
            grad = grad * min(1.0, 1.0 / (norm + 1e-9))
            first, second = moments[name]
            first += 0.1 * (grad - first)
            second += 0.005 * (grad * grad - second)
            own = getattr(weights, name)
            if name in ("project", "recurrent", "out"):
                own *= np.float32(1 - 0.01 * pace)
            own -= (pace * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.995**steps)) + 1e-8)).astype(np.float32)
        mean = loss if steps == 1 else 0.98 * mean + 0.02 * loss
        if steps % 50 == 0:
            say(f"{steps} steps, {time.time() - began:.0f} s, loss {mean:.5f}", flush=True)
    weights.packed = weights.stepper = None
    return weights


def table_messages(path: str) -> list[str]:
    import pyarrow.parquet as pq

    rows = pq.read_table(path, columns=["messages"]).column(0).to_pylist()
    return sorted({m["content"] for r in rows for m in r or [] if m and m["content"]})


def activity(weights: Weights, messages: list[str]) -> np.ndarray:
    """Spread of each hidden unit (2, H) over messages."""
    data, lengths = padded([symbols(m) for m in messages if m])
    place = np.arange(data.shape[1])
    backward = np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place)
    streams = np.stack([data, np.take_along_axis(data, backward, 1)]).transpose(2, 0, 1)
    inputs, hidden = weights.inputs, weights.hidden
    state, cell = (np.zeros((2, len(data), hidden), np.float32) for _ in range(2))
    seen = []
    for t in range(int(np.median(lengths))):
        raw = state @ weights.recurrent + np.stack([inputs[k][streams[t, k]] for k in range(2)])
        let, keep, show = (sigmoid(raw[..., k * hidden : (k + 1) * hidden]) for k in range(3))
        cell = keep * cell + let * np.tanh(raw[..., 3 * hidden :])
        state = show * np.tanh(cell)
        seen.append(state.std(axis=1))
    return np.mean(seen, axis=0)


def pruned(weights: Weights, messages: list[str], hidden: int) -> Weights:
    """The model with the ``hidden`` units of each direction that move most of what they feed; to be fitted on afterwards."""
    moved = activity(weights, messages) * np.stack([np.linalg.norm(weights.recurrent[d], axis=1) + 3 * np.linalg.norm(weights.out[d * weights.hidden : (d + 1) * weights.hidden], axis=1) for d in range(2)])
    keep = [np.sort(np.argsort(-moved[d])[:hidden]) for d in range(2)]
    gates = [np.concatenate([own + k * weights.hidden for k in range(4)]) for own in keep]
    both = lambda x, at: np.stack([x[d][..., at[d]] for d in range(2)])
    return Weights(
        weights.embed.copy(), both(weights.project, gates), both(weights.shift, gates), np.stack([weights.recurrent[d][keep[d]][:, gates[d]] for d in range(2)]),
        np.concatenate([weights.out[d * weights.hidden + keep[d]] for d in range(2)]), weights.bias.copy(), weights.transitions.copy(), weights.start.copy(),
    )


def train(messages: list[str], minutes: float) -> Weights:
    """Two models, then rounds of self-training: by what both agree on, then by what the better one finds, then by both again;
    at last the model is pruned to ``KEPT`` units a direction and fitted on."""
    copied = lambda w: Weights(*(getattr(w, n).copy() for n in Weights.NAMES))
    first, second = (fit(messages, minutes, h, h) for h in (HIDDEN, HIDDEN + 4))
    first = fit(messages, minutes / 2, 3, rate=0.004, start=copied(first), models=[first, second])
    again = [fit(messages, minutes / 4, 4 + k, rate=0.003, start=copied(w), models=[first]) for k, w in enumerate((first, second))]
    first = fit(messages, minutes / 4, 6, rate=0.003, start=copied(again[0]), models=again)
    return fit(messages, minutes / 3, 8, rate=0.003, start=pruned(first, messages[:2000], KEPT), models=[first])


if __name__ == "__main__":
    train(table_messages(sys.argv[1]), float(sys.argv[3]) if len(sys.argv) > 3 else 30.0).save(sys.argv[2])
