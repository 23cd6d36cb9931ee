"""Names of places with the stems of their inflected forms: fixed values, in the order of their regions.

A form is a run of words; a word that ends in * stands for any word that begins so. Letters have no marks, as texts are compared
without them.
"""

#: Countries.
COUNTRIES = {
    "Polska": ("polsk*",),
    "Niemcy": ("niemc*", "niemiec*",),
    "Francja": ("franc*",),
    "Wielka Brytania": ("wielk* brytani*", "brytyj*", "zjednoczon* krolestw*",),
    "Włochy": ("wloch*", "wlos*",),
    "Hiszpania": ("hiszpan*",),
    "Portugalia": ("portugal*",),
    "Holandia": ("holand*", "niderland*",),
    "Belgia": ("belgi*",),
    "Szwajcaria": ("szwajcar*",),
    "Austria": ("austri*",),
    "Szwecja": ("szwecj*", "szwedz*",),
    "Norwegia": ("norweg*",),
    "Dania": ("dani*", "dunsk*", "dunczy*",),
    "Finlandia": ("finland*", "fins*",),
    "Islandia": ("island*",),
    "Irlandia": ("irland*",),
    "Grecja": ("grecj*", "greck*",),
    "Cypr": ("cypr*",),
    "Malta": ("malt*",),
    "Czechy": ("czech*", "czesk*",),
    "Słowacja": ("slowacj*", "slowack*",),
    "Węgry": ("wegr*", "wegiersk*",),
    "Rumunia": ("rumun*",),
    "Bułgaria": ("bulgar*",),
    "Chorwacja": ("chorwac*",),
    "Słowenia": ("sloweni*",),
    "Bośnia i Hercegowina": ("bosni* i hercegowin*", "bosniack*",),
    "Serbia": ("serb*",),
    "Czarnogóra": ("czarnogor*",),
    "Macedonia Północna": ("macedoni* polnocn*", "macedonsk*",),
    "Albania": ("alban*",),
    "Kosowo": ("kosow*",),
    "Mołdawia": ("moldaw*",),
    "Ukraina": ("ukrain*",),
    "Białoruś": ("bialorus*",),
    "Litwa": ("litewsk*", "litw*",),
    "Łotwa": ("lotewsk*", "lotw*",),
    "Estonia": ("eston*",),
    "Rosja": ("rosj*", "rosyj*",),
    "Andora": ("andor*",),
    "Monako": ("monak*",),
    "San Marino": ("san marin*",),
    "Liechtenstein": ("liechtenstein*",),
    "Watykan": ("watykan*",),
    "Luksemburg": ("luksembur*",),
    "Chiny": ("chin*",),
    "Japonia": ("japon*",),
    "Korea Południowa": ("kore* poludniow*",),
    "Korea Północna": ("kore* polnocn*",),
    "Indie": ("indi*", "hindus*",),
    "Pakistan": ("pakistan*",),
    "Bangladesz": ("banglades*",),
    "Sri Lanka": ("sri lank*",),
    "Nepal": ("nepal*",),
    "Bhutan": ("bhutan*",),
    "Malediwy": ("malediw*",),
    "Afganistan": ("afganistan*", "afgansk*",),
    "Iran": ("iran*", "iransk*",),
    "Irak": ("irak*", "irac*",),
    "Arabia Saudyjska": ("arabi* saudyjsk*", "saudyjsk*",),
    "Jemen": ("jemen*",),
    "Oman": ("oman*",),
    "Zjednoczone Emiraty Arabskie": ("zjednoczon* emirat* arabski*", "emirat* arabski*", "emirat*",),
    "Katar": ("katar*",),
    "Bahrajn": ("bahrajn*", "bahrejn*",),
    "Kuwejt": ("kuwejt*",),
    "Jordania": ("jordani*",),
    "Liban": ("liban*",),
    "Syria": ("syri*", "syryjsk*",),
    "Izrael": ("izrael*",),
    "Palestyna": ("palestyn*",),
    "Turcja": ("turcj*", "tureck*",),
    "Gruzja": ("gruzj*", "gruzin*",),
    "Armenia": ("armen*",),
    "Azerbejdżan": ("azerbejdzan*",),
    "Kazachstan": ("kazachstan*", "kazach*",),
    "Uzbekistan": ("uzbekistan*", "uzbeck*",),
    "Turkmenistan": ("turkmenistan*", "turkmen*",),
    "Tadżykistan": ("tadzykistan*", "tadzyck*",),
    "Kirgistan": ("kirgistan*", "kirgis*",),
    "Mongolia": ("mongol*",),
    "Tajwan": ("tajwan*",),
    "Wietnam": ("wietnam*",),
    "Laos": ("laos*", "laotansk*",),
    "Kambodża": ("kambodz*",),
    "Tajlandia": ("tajland*", "tajsk*",),
    "Mjanma": ("mjanm*", "birm*",),
    "Malezja": ("malezj*",),
    "Singapur": ("singapur*",),
    "Indonezja": ("indonezj*",),
    "Filipiny": ("filipin*",),
    "Brunei": ("brunei*",),
    "Timor Wschodni": ("timor* wschodni*",),
    "Egipt": ("egipt*",),
    "Libia": ("libi*", "libijsk*",),
    "Tunezja": ("tunezj*", "tunezyjsk*",),
    "Algieria": ("algier*",),
    "Maroko": ("marok*", "marokansk*",),
    "Sahara Zachodnia": ("sahar* zachodni*",),
    "Mauretania": ("mauretan*",),
    "Mali": ("mali", "malijsk*",),
    "Niger": ("niger", "nigr*",),
    "Nigeria": ("nigeri*", "nigeryjsk*",),
    "Czad": ("czad*",),
    "Sudan": ("sudan*",),
    "Sudan Południowy": ("sudan* poludniow*",),
    "Erytrea": ("erytre*",),
    "Dżibuti": ("dzibut*",),
    "Etiopia": ("etiop*",),
    "Somalia": ("somal*",),
    "Kenia": ("keni*", "kenijsk*",),
    "Uganda": ("ugand*",),
    "Tanzania": ("tanzan*",),
    "Rwanda": ("rwand*",),
    "Burundi": ("burund*",),
    "Demokratyczna Republika Konga": ("demokratyczn* republik* kong*", "kongijsk*",),
    "Republika Konga": ("republik* kong*",),
    "Gabon": ("gabon*",),
    "Gwinea Równikowa": ("gwine* rownikow*",),
    "Kamerun": ("kamerun*",),
    "Republika Środkowoafrykańska": ("srodkowoafrykansk*",),
    "Benin": ("benin*",),
    "Togo": ("togo", "togijsk*",),
    "Ghana": ("ghan*",),
    "Wybrzeże Kości Słoniowej": ("wybrzez* kosci sloniow*", "iworyjsk*",),
    "Liberia": ("liberi*",),
    "Sierra Leone": ("sierr* leone*",),
    "Gwinea": ("gwine*",),
    "Gwinea Bissau": ("gwine* bissau*",),
    "Senegal": ("senegal*",),
    "Gambia": ("gambi*",),
    "Republika Zielonego Przylądka": ("zielon* przyladk*",),
    "Burkina Faso": ("burkin* faso*",),
    "Angola": ("angol*",),
    "Zambia": ("zambi*",),
    "Zimbabwe": ("zimbabwe*",),
    "Mozambik": ("mozambik*",),
    "Malawi": ("malawi", "malawijsk*",),
    "Madagaskar": ("madagaskar*",),
    "Mauritius": ("mauritius*",),
    "Seszele": ("seszel*",),
    "Komory": ("komor*",),
    "Botswana": ("botswan*",),
    "Namibia": ("namibi*",),
    "Eswatini": ("eswatini", "suazi*",),
    "Lesotho": ("lesotho",),
    "Republika Południowej Afryki": ("poludniow* afryk*", "rpa", "poludniowoafrykansk*",),
    "Stany Zjednoczone": ("stan* zjednoczon*", "amerykansk*", "usa",),
    "Kanada": ("kanad*",),
    "Meksyk": ("meksyk*",),
    "Gwatemala": ("gwatemal*",),
    "Belize": ("belize*",),
    "Honduras": ("hondura*",),
    "Salwador": ("salwador*",),
    "Nikaragua": ("nikaragu*",),
    "Kostaryka": ("kostaryk*",),
    "Panama": ("panam*",),
    "Kuba": ("kub*",),
    "Jamajka": ("jamajk*",),
    "Haiti": ("haiti", "haitansk*",),
    "Dominikana": ("dominikan*",),
    "Bahamy": ("baham*",),
    "Barbados": ("barbados*",),
    "Trynidad i Tobago": ("trynidad*", "tobago*",),
    "Antigua i Barbuda": ("antigu*", "barbud*",),
    "Saint Kitts i Nevis": ("kitts*", "nevis*",),
    "Dominika": ("dominik*",),
    "Saint Lucia": ("saint luci*", "lucia*",),
    "Saint Vincent i Grenadyny": ("vincent*", "grenadyn*",),
    "Grenada": ("grenad*",),
    "Kolumbia": ("kolumbi*",),
    "Wenezuela": ("wenezuel*",),
    "Gujana": ("gujan*",),
    "Surinam": ("surinam*",),
    "Ekwador": ("ekwador*",),
    "Peru": ("peru", "peruwiansk*",),
    "Brazylia": ("brazyli*",),
    "Boliwia": ("boliwi*",),
    "Paragwaj": ("paragwaj*",),
    "Chile": ("chile", "chilijsk*",),
    "Argentyna": ("argentyn*",),
    "Urugwaj": ("urugwaj*",),
    "Australia": ("australi*",),
    "Nowa Zelandia": ("now* zeland*", "nowozelandzk*",),
    "Papua-Nowa Gwinea": ("papu* now* gwine*",),
    "Fidżi": ("fidzi", "fidzyjsk*",),
    "Wyspy Salomona": ("wysp* salomon*",),
    "Vanuatu": ("vanuatu*",),
    "Samoa": ("samoa*",),
    "Tonga": ("tong*",),
    "Kiribati": ("kiribati",),
    "Tuvalu": ("tuvalu*",),
    "Nauru": ("nauru*",),
    "Palau": ("palau*",),
    "Mikronezja": ("mikronezj*",),
    "Wyspy Marshalla": ("wysp* marshall*",),
}
#: Cities that the reports name often, each with the forms of its transliterations.
CITIES = {
    "Omdurman": ("omdurman*",),
    "Al-Faszir": ("al faszir*",),
    "Al-Ubajjid": ("al ubajjid*", "al ubajid*"),
    "Port Sudan": ("port sudan*",),
}
#: Seas, gulfs, straits, canals and oceans.
WATERS = {
    "Morze Czerwone": ("morz* czerwon*",),
    "Morze Czarne": ("morz* czarn*",),
    "Morze Śródziemne": ("morz* srodziemn*",),
    "Morze Bałtyckie": ("morz* baltyck*",),
    "Morze Północne": ("morz* polnocn*",),
    "Morze Kaspijskie": ("morz* kaspijsk*",),
    "Morze Arabskie": ("morz* arabski*",),
    "Morze Żółte": ("morz* zolt*",),
    "Morze Południowochińskie": ("morz* poludniowochinsk*",),
    "Zatoka Perska": ("zatok* persk*", "zatoc* persk*",),
    "Zatoka Meksykańska": ("zatok* meksykansk*", "zatoc* meksykansk*",),
    "Zatoka Gwinejska": ("zatok* gwinejsk*", "zatoc* gwinejsk*",),
    "Zatoka Adeńska": ("zatok* adensk*", "zatoc* adensk*",),
    "Zatoka Bengalska": ("zatok* bengalsk*", "zatoc* bengalsk*",),
    "Zatoka Omańska": ("zatok* omansk*", "zatoc* omansk*",),
    "Cieśnina Ormuz": ("ciesnin* ormuz*",),
    "Cieśnina Gibraltarska": ("ciesnin* gibraltarsk*",),
    "Cieśnina Bosfor": ("ciesnin* bosfor*",),
    "Kanał Sueski": ("kanal* suesk*",),
    "Kanał Panamski": ("kanal* panamsk*",),
    "Ocean Spokojny": ("ocean* spokojn*",),
    "Ocean Indyjski": ("ocean* indyjsk*",),
    "Ocean Atlantycki": ("ocean* atlantyck*",),
    "Ocean Arktyczny": ("ocean* arktyczn*",),
}
#: Parts of foreign countries.
PROVINCES = {
    "Kordofan Północny": ("kordofan* polnocn*",),
}
#: Regions without borders of their own, and a point (latitude, longitude) to show each at.
REGIONS = {
    "Sahel": ("sahel*",),
    "Bliski Wschód": ("blisk* wscho*",),
    "Róg Afryki": ("rog* afryk*",),
    "Europa Wschodnia": ("europ* wschodni*",),
    "Europa Zachodnia": ("europ* zachodni*",),
    "Afryka Subsaharyjska": ("afryk* subsaharyjsk*", "afryc* subsaharyjsk*"),
    "Ameryka Łacińska": ("ameryk* lacinsk*", "ameryc* lacinsk*"),
    "Azja Środkowa": ("azj* srodkow*",),
    "Kaukaz": ("kaukaz*",),
    "Lewant": ("lewant*", "lewanc*"),
    "Azja Południowo-Wschodnia": ("azj* poludniowo* wschodni*",),
    "Skandynawia": ("skandynawi*",),
}
REGION_POINTS = {
    "Sahel": (15.0, 10.0),
    "Bliski Wschód": (30.0, 45.0),
    "Róg Afryki": (8.0, 45.0),
    "Europa Wschodnia": (50.0, 30.0),
    "Europa Zachodnia": (48.0, 4.0),
    "Afryka Subsaharyjska": (2.0, 20.0),
    "Ameryka Łacińska": (-10.0, -60.0),
    "Azja Środkowa": (43.0, 65.0),
    "Kaukaz": (42.0, 44.0),
    "Lewant": (34.0, 37.0),
    "Azja Południowo-Wschodnia": (5.0, 105.0),
    "Skandynawia": (62.0, 15.0),
}
#: Abbreviations (capitals only) and inhabitants of countries, names to ask a geocoder for instead, pairs of surface and lemma that are no name.
COUNTRY_CODES = {"PL": "Polska", "UA": "Ukraina"}
INHABITANTS = {"finowie": "Finlandia", "grecy": "Grecja", "turcy": "Turcja", "turk": "Turcja", "węgrzy": "Węgry", "wegrzy": "Węgry", "włosi": "Włochy", "wlosi": "Włochy"}
GEOCODE_NAMES = {"Al-Faszir": "El Fasher"}
REJECTED_PAIRS = (("dana", "dan", ("ADJ", "NOUN", "PROPN")),)
