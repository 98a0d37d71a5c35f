"""Word tables of name matching. Fixed values, stated as text in their natural order."""

from __future__ import annotations

# Titles and particles that are no name parts.
HONORIFICS = tuple("MR MRS MS MISS DR PROF HAJI HAJJI MAULANA MAWLAWI MULLAH MOLVI QARI ENGR ENG SIR GENERAL COLONEL AL EL UL UR US UD BIN IBN BINT".split())
# Titles that do not count where they have no partner.
SOFT_TITLES = "SAYED MIAN SARDAR MALIK CHAUDHRY KHAWAJA SAHIBZADA SHEIKH NAWAB RAJA RANA PIR MAKHDOOM MIR BEGUM SARDARZADA NAWABZADA".split()
# Name parts too common to carry a name on their own.
COMMON_PARTS = "MUHAMMAD ALI KHAN AHMAD HUSSAIN HASSAN SAYED SHAH MALIK ABDUL ABDULLAH RAHMAN DIN ULLAH MIAN SHEIKH RAZA BIBI BEGUM KUMAR".split()
# Spellings of a fused first part, and second parts that may follow it.
ABDUL_PREFIXES = ("ABDUL", "ABDUR", "ABDUS", "ABDEL", "ABDOL", "ABDOUL")
ABDUL_SECOND = frozenset(
    "RAHMAN REHMAN RAHIM REHIM AZIZ KARIM KAREEM QADIR KADER SALAM SAMAD GHAFFAR GHAFOOR RAZZAQ RAZAQ HAKIM HAMID MAJID WAHID WAHAB BASIT BARI JABBAR LATIF "
    "MALIK MANAN QAYYUM RASHID RAOOF SATTAR SHAKOOR WADOOD HAQ HADI HAFIZ GHANI NASIR SABOOR RAUF QUDDUS SAMI BASIR HALIM MUHSIN MOHSIN NOOR HAMEED MAJEED".split()
)
# Parts that are often written together.
FUSE_WORDS = frozenset(
    "MUHAMMAD ALI KHAN AHMAD HUSSAIN HASSAN SHAH HAQ RAHMAN DIN ULLAH ALLAH NAWAZ SHARIF HAMID MAJID RAZA SAEED NOOR FAZAL SIRAJ ZIA ABDUL RAUF AZIZ KARIM LATIF "
    "MALIK AKBAR ASGHAR REHMAN IQBAL JAN GUL BAKHSH DAD MIR ZADA SULTAN FAROOQ TARIQ IMRAN NAEEM WALI KHALID SALIM UMAR USMAN BILAL HAIDER NASIR FAIZ SHER "
    "BAZ RASHID SAJID ZAFAR AMIN YOUSAF YUSUF IBRAHIM ISMAIL MUSTAFA SULEMAN".split()
)
# Spelling habits folded one after the other.
PHONETIC = (("GH", "G"), ("PH", "F"), ("OO", "U"), ("EE", "I"), ("OU", "U"), ("AI", "E"), ("AY", "E"))
# Families of one name, the canonical spelling first. All spellings are stated, also those that the phonetic
# rule would fold alike: a fused name is cut before the phonetic rule runs. A site with families of its own passes them as ``families``.
FAMILIES = """
MUHAMMAD: MOHAMMED MOHAMMAD MOHAMED MUHAMMED MUHAMED MUHAMAD MOHAMAD MOHD MUHD MD MAHOMED MOUHAMED MOUHAMMED MUHAMMET MOHAMET MOHAMMADD
AHMAD: AHMED AHMET AHMAAD
HUSSAIN: HUSSEIN HUSAIN HOSSAIN HOSSEIN HUSEIN HOSEIN HUSSAYN HUSAYN HOSAIN
HASSAN: HASAN HASSEN
UMAR: OMAR OMER UMER
USMAN: OSMAN UTHMAN OTHMAN UTHMAAN
IBRAHIM: EBRAHIM IBRAHEEM EBRAHEEM IBRAHEM
ISMAIL: ISMAEEL ISMAEL ISMAYIL ISMAIEL ISMAYEL
YUSUF: YOUSUF YUSSUF YOUSEF YUSEF YOUSOUF YUSOUF YOUSAF YUSAF YUSAAF YOUSAAF
ZIA: ZIAUL ZIYA
FAZAL: FAZL FAZLUR FAZLE FAZLI
SAYED: SYED SAYYED SAYYID SAYID SEYED
SHEIKH: SHAIKH SHAYKH SHEIK SHAIK SHEKH
ABDUL: ABDOL ABDEL ABD ABDOUL ABDOOL ABDELL
ABDULLAH: ABDALLAH ABDULLA ABDOLLAH ABDELLAH ABDALLA
RAHMAN: REHMAN RAHMAAN REHMAAN
MAHMOOD: MAHMUD MAHMOUD MEHMOOD MEHMUD
KHALID: KHALED KHALEED
SALIM: SALEEM
NASIR: NASSER NASER NASEER
SAEED: SAID SAYEED
ZUBAIR: ZUBAYR ZUBEIR ZOBAIR ZUBEER
HAMZA: HAMZAH HAMZEH
USAMA: OSAMA OSSAMA USAMAH OSAMAH
ZULFIQAR: ZULFIKAR ZULFEKAR ZULFIQUAR
SIDDIQUI: SIDDIQI SIDDIQUE SIDIQI SIDDIQUEE
QURESHI: KUREISHI QURAISHI QURAYSHI KURESHI
CHAUDHRY: CHAUDHARY CHAUDHRI CHAUDHURY CHOUDHARY CHOUDHRY CHAUDRY CHOUDHURY CHOWDHURY CH CHDHRY
HAQ: HUQ HAQUE HUQUE
MUSTAFA: MUSTAPHA MOSTAFA MOUSTAFA
FATIMA: FATIMAH FATEMA FATEMAH
AISHA: AYESHA AYSHA AISHAH AYISHA AAISHA
JAVED: JAVID JAVEED JAWED JAWID
IQBAL: IKBAL
QASIM: KASIM QASSIM QASEM KASEM
TARIQ: TAREK TAREQ TARIK TAREEQ
SULAIMAN: SULEIMAN SULAYMAN SULEMAN SOLIMAN SOLEIMAN
HAFIZ: HAFEEZ HAFEZ
MASOOD: MASUD MASOUD
JAMIL: JAMEEL JAMEL
KARIM: KAREEM KERIM
RASHID: RASHEED RASHED
NOOR: NUR NOUR NURUL NOORUL
ABU: ABOU ABOO
KHAN: KHANN
FAROOQ: FAROUK FARUQ FAROUQ FARUK FAROOK FARUKH
HAMID: HAMEED HAMED
MAJID: MAJEED MAJED
KHAWAJA: KHWAJA KHAJA KHAWAJAH KHAWJA KHWAJAH
GILANI: GILLANI GEELANI GILANEE GEELANEE
REHAN: RAIHAN RIHAN RAYHAN RAIHAAN
ALEXEI: ALEKSEI ALEXEY ALEKSEY ALEXEJ ALEKSEJ
TAREEN: TARIN TAREN
MIR: MEER
GADDAFI: GADHAFI QADDAFI QADHAFI KADHAFI KADDAFI GHADDAFI QADAFI GADAFI
SHAKEEL: SHAKIL SHAKEIL
SHAHEEN: SHAHIN SHAHEIN
MUSHARRAF: MUSHARAF MOSHARRAF
RAFIQ: RAFEEQ RAFIK RAFEEK
ZAFAR: ZAFFAR ZUFAR
SHAUKAT: SHAWKAT SHAUKET
NAVEED: NAVED NAVEEDD NAWEED
WAQAR: WAQQAR WAKAR
SHAHID: SHAHEED SHAHED
BASHIR: BASHEER BASHEIR
AKHTAR: AKHTER AKTAR
SULTAN: SULTHAN SULTANN
BILAL: BELAL BILLAL
SOHAIL: SUHAIL SUHEIL SOHEIL
ANWAR: ANWER ANOUAR
"""


def variants(families: str = FAMILIES) -> dict[str, str]:
    """Spelling -> canonical spelling, from lines ``CANONICAL: SPELLING ...``."""
    out = {}
    for line in families.strip().splitlines():
        canonical, _, spellings = line.partition(":")
        out.update(dict.fromkeys(spellings.split(), canonical.strip()))
    return out


# Legal forms of companies.
LEGAL_FORMS = frozenset("LLC LLP LTD LIMITED INC INCORPORATED CORP CORPORATION PLC GMBH SRL SARL SAS SPA BV NV OOO JSC PJSC PTE EIRL SDN BHD FZE FZCO FZC PVT COMPANY CO".split())
# Legal forms that are also written with dots or blanks between their letters.
SPACED_LEGAL = "SAS SARL SRL SPA SACV SADECV GMBH LLC LLP LTD PLC PTE BV NV AG SA CA SL OOO JSC PJSC".split()
# Word stems of adverse news, as regular expressions.
ADVERSE = (
    "arrest\\w*", "charged", "charges", "convict\\w*", "sentenc\\w*", "fraud\\w*", "launder\\w*", "terror\\w*", "militant\\w*", "smuggl\\w*", "traffick\\w*", "corrupt\\w*",
    "brib\\w*", "sanction\\w*", "wanted", "indict\\w*", "scam\\w*", "extort\\w*", "kidnap\\w*", "embezzl\\w*", "money trail", "warrant\\w*", "militan\\w*", "banned",
)
