"""Fixed vocabularies of web-page furniture in six languages.

Everything is matched on an ASCII skeleton (lower-case a-z only, see :func:`skeleton`), so a line whose accented letters
were destroyed by a wrong decoding still matches its entry.
"""

from __future__ import annotations

import ahocorasick

_NOT_AZ = bytes(x for x in range(128) if not 97 <= x <= 122)


def skeleton(text: str) -> str:
    """Lower-case ASCII letters of ``text`` and nothing else."""
    return letters(text.lower())


def letters(low: str) -> str:
    """:func:`skeleton` of a text in lower case."""
    return low.encode("ascii", "ignore").translate(None, _NOT_AZ).decode("ascii")


# Labels that sites use in their menus.
MENU = {
    "de": "Startseite;Home;Über uns;Wir über uns;Unternehmen;Firma;Produkte;Leistungen;Service;Aktuelles;Neuigkeiten;Presse;"
    "Karriere;Jobs;Stellenangebote;Kontakt;Impressum;Datenschutz;Sitemap;Suche;Downloads;Anfahrt;Referenzen;Geschichte;"
    "Händlersuche;Händler;Ansprechpartner;Login;Anmelden;Warenkorb;AGB;Hilfe;Team;Partner;Galerie",
    "en": "Home;About us;Company;Products;Services;News;Press;Careers;Jobs;Contact;Contact us;Legal notice;Imprint;Privacy;"
    "Privacy policy;Site map;Sitemap;Search;Downloads;Directions;References;History;Dealers;Team;Login;Log in;Help;Cart",
    "fr": "Accueil;Qui sommes-nous;Entreprise;Produits;Services;Actualités;Presse;Carrières;Emplois;Contact;Mentions légales;"
    "Confidentialité;Plan du site;Recherche;Téléchargements;Plan d’accès;Références;Histoire;Revendeurs;Équipe;Connexion;Aide",
    "es": "Inicio;Quiénes somos;Empresa;Productos;Servicios;Noticias;Prensa;Empleo;Contacto;Aviso legal;Privacidad;Mapa web;"
    "Mapa del sitio;Buscar;Descargas;Cómo llegar;Referencias;Historia;Distribuidores;Equipo;Acceso;Ayuda",
    "it": "Home page;Chi siamo;Azienda;Prodotti;Servizi;Notizie;Stampa;Lavora con noi;Contatti;Note legali;Privacy;"
    "Mappa del sito;Cerca;Scarica;Dove siamo;Referenze;Storia;Rivenditori;Squadra;Accedi;Aiuto",
    "nl": "Startpagina;Over ons;Bedrijf;Producten;Diensten;Nieuws;Pers;Werken bij;Vacatures;Contact;Colofon;Privacy;Overzicht;"
    "Zoeken;Downloads;Route;Referenties;Geschiedenis;Dealers;Team;Inloggen;Hulp",
}
MENU_KEYS = frozenset(skeleton(x) for words in MENU.values() for x in words.split(";"))

# Openings of a breadcrumb trail.
TRAIL = "Sie sind hier;Sie befinden sich hier;You are here;Vous êtes ici;Usted está aquí;Está aquí;Ti trovi qui;Sei qui;U bent hier;Je bent hier"

# Prompts and standing lines of a site (cookies, sharing, newsletter, printing, footer, toolbar, credits).
PROMPTS = {
    "cookie": "verwendet Cookies;Informationen auf Ihrem Gerät;stimmen Sie der Speicherung;kleine Textdateien;notwendige Cookies;"
    "uses cookies;our use of cookies;information on your device;small text files;necessary cookies;utilise des cookies;"
    "utilisation de cookies;informations sur votre appareil;Cookies nécessaires;utiliza cookies;uso de cookies;información en su dispositivo;"
    "cookies necesarias;utilizza i cookie;uso dei cookie;informazioni sul tuo dispositivo;cookie necessari;gebruikt cookies;"
    "gebruik van cookies;gegevens op uw apparaat;noodzakelijke cookies;petits fichiers texte;pequeños archivos de texto;"
    "piccoli file di testo;kleine tekstbestanden;Cookie-Einstellungen;cookie settings",
    "share": "Artikel teilen;Seite weiterempfehlen;Per E-Mail senden;Sagen Sie es weiter;Folgen Sie uns;Share this article;"
    "Recommend this page;Send by e-mail;Tell a friend;Follow us;Partager cet article;Recommander cette page;Envoyer par courriel;"
    "Suivez-nous;Parlez-en autour de vous;Compartir este artículo;Recomendar esta página;Enviar por correo;Síganos;Condividi l’articolo;"
    "Consiglia questa pagina;Invia per e-mail;Seguici;Deel dit artikel;Beveel deze pagina aan;Verstuur per e-mail;Volg ons;"
    "Vertel het verder;Teilen Sie diesen Beitrag;Share on",
    "letter": "Newsletter abonnieren;Subscribe to our newsletter;Abonnez-vous à notre lettre;Suscríbase a nuestro boletín;Suscríbase al boletín;"
    "Iscriviti alla nostra newsletter;Schrijf u in voor onze nieuwsbrief;Jetzt Newsletter",
    "print": "Seite drucken;Print this page;Imprimer cette page;Imprimir esta página;Stampa questa pagina;Pagina afdrukken;nach oben;"
    "back to top;haut de page;volver arriba;torna su;naar boven",
    "site": "Alle Rechte vorbehalten;All rights reserved;Tous droits réservés;Todos los derechos reservados;Tutti i diritti riservati;"
    "Alle rechten voorbehouden;Gestaltung und Umsetzung;Site built by;Réalisation agence;Diseño agencia;Realizzato da;Gebouwd door;"
    "Allgemeinen Verkaufsbedingungen;general terms of sale;conditions générales de vente;condiciones generales de venta;"
    "condizioni generali di vendita;algemene verkoopvoorwaarden;gesetzlichen Mehrwertsteuer;All prices plus VAT;Prix hors taxes;"
    "Precios sin IVA;Prezzi al netto;Alle prijzen exclusief;AGB Impressum;Terms Legal notice;CGV Mentions légales;"
    "Condiciones Aviso legal;Condizioni Note legali;Voorwaarden Colofon",
    "toolbar": "replay toolbar;Leiste ausblenden;Archivkopie;barre de relecture;barra de reproducción;Copia de archivo;Copie d’archive;"
    "Copia d’archivio;Archiefkopie;barra dell’archivio;archiefbalk;Capture no",
    "change": "zuletzt geändert am;last changed on;modifiée le;modificada el;modificata il;gewijzigd op;letzte Änderung;last modified",
    "credit": "Bildnachweis;Photo credit;Crédit photo;Foto archief;Foto archivo;Foto archivio;Fotos archivo;Beitrag von der Redaktion;Story by the;"
    "Texto redacción;Tekst redactie;Texte rédaction;Rédaction équipe;Testo redazione;Article de la rédaction;Articolo della redazione;Un article de la;Un artículo de la;"
    "Artikel van de redactie;Foto Archiv;Archivo fotográfico;Crediti foto;Crédito de la foto;Par la rédaction;Por la redacción;A cura della redazione",
}
# Short lines that are a prompt only when they fill the whole line.
WHOLE = (
    "OK, verstanden;Alle akzeptieren;Einverstanden;OK, I understand;Got it;Accept all;J’ai compris;Tout accepter;Entendido;Aceptar todo;"
    "Ho capito;Accetta tutto;Accetta tutti;Begrepen;Alles accepteren;Schnellzugriff;Quick links;Accès rapide;Accesos rápidos;Link rapidi;Snel naar;"
    "Ihr Ansprechpartner;Your contact person;Votre interlocuteur;Su persona de contacto;La tua persona di riferimento;Il tuo referente;Uw contactpersoon;"
    "nach oben;Drucken;Print;Teilen;Share"
)
# Headings above links to other pages.
TEASERS = (
    "Weitere Meldungen;Meistgelesen;Unsere Bestseller;Termine;Das könnte Sie auch interessieren;Aktuelle Meldungen;More news;Most read;"
    "Our bestsellers;Upcoming dates;You may also like;Related articles;Autres actualités;Les plus lus;Nos meilleures ventes;Agenda;À lire aussi;"
    "Más noticias;Lo más leído;Los más vendidos;Nuestros superventas;Agenda de actos;También le puede interesar;Altre notizie;I più letti;I nostri bestseller;"
    "I più venduti;Appuntamenti;Potrebbe interessarti;Meer nieuws;Meest gelezen;Onze bestsellers;Misschien ook interessant;Agenda;Onze toppers"
)
MORE = "mehr erfahren;weiterlesen;read more;en savoir plus;lire la suite;leer más;saber más;leggi tutto;continua a leggere;lees meer;lees verder;meer lezen"

# Notices that scripts or frames are needed.
SCRIPT = (
    "aktivieren Sie JavaScript;eingeschaltetes JavaScript;Ausführen von Scripts abgeschaltet;werden Skripte benötigt;requires JavaScript;"
    "enable JavaScript;support frames or scripting;allow scripts to run;activer JavaScript;besoin de scripts;scripts pour fonctionner;"
    "Active JavaScript;necesita scripts;Abilita JavaScript;attivare gli script;Schakel JavaScript;scripts nodig;JavaScript is disabled;"
    "JavaScript ist deaktiviert;JavaScript est désactivé;navigateur ne prend pas en charge les cadres;navegador no admite marcos;"
    "browser non supporta i frame;browser ondersteunt geen frames"
)
# Error, maintenance and parking notices.
NOTICE = (
    "Seite nicht gefunden;angeforderte Seite existiert;Seite existiert leider nicht;Inhalt konnte nicht geladen werden;Sitzung ist abgelaufen;"
    "etwas schiefgelaufen;Hoppla hier ist etwas schiefgelaufen;Oops something went wrong;Zugriff verweigert;Wegen Wartungsarbeiten;Interner Fehler;Domain wurde geparkt;steht zum Verkauf;Hier entsteht in Kürze;neue Internetpräsenz;"
    "Page not found;page you requested does not exist;requested content could not be loaded;session has expired;something went wrong;Access denied;"
    "down for maintenance;internal error occurred;domain is parked;web site is coming soon;website is coming soon;page non trouvée;page introuvable;page demandée n’existe plus;"
    "contenu demandé n’a pas pu;session a expiré;Une erreur est survenue;erreur interne;Accès refusé;Site en maintenance;nom de domaine est à vendre;Un nouveau site;Notre nouveau site;Nuestro nuevo sitio;Nuestra nueva web;Il nostro nuovo sito;Onze nieuwe website;Onze nieuwe site;"
    "página no encontrada;página solicitada ya no existe;contenido solicitado no;sesión ha caducado;sesión ha expirado;Algo ha salido mal;Se ha producido un error;"
    "error interno;Acceso denegado;en mantenimiento;por mantenimiento;dominio está en venta;nuevo sitio web;pagina non trovata;pagina richiesta non esiste;"
    "contenuto richiesto non;sessione è scaduta;Qualcosa è andato storto;Si è verificato un errore;errore interno;Accesso negato;in manutenzione;per manutenzione;"
    "dominio è in vendita;nuovo sito;pagina niet gevonden;gevraagde pagina bestaat niet;gevraagde inhoud kon niet;sessie is verlopen;iets misgegaan;interne fout;"
    "Toegang geweigerd;Wegens onderhoud;domeinnaam is te koop;nieuwe website;Gateway timeout;Bad gateway;Service unavailable;Internal Server Error;"
    "Server Error in;Stack trace;Fatal error;Parse error;Uncaught exception;Call to undefined function"
)
# Openings of raw program messages, seen on the text as it stands.
RAW = (
    r"(?:(?:Warning|Fatal error|Notice|Parse error|Uncaught \w+|Traceback|Exception)\s?[:(]|SQLSTATE\b|Stack trace:|"
    r"(?:HTTP|Status|Code|Error|Fehler|Erreur|Errore|Fout)\b[ :]*\d{3}\b|\[\d{3}\] ?/|\d{3}\W{1,6}(?:Seite|Page|Pagina|P\S{1,4}gina|Not|Forbidden|Error)\b|"
    r"Gateway timeout|Server Error in|An internal error|ORA-\d+|Microsoft OLE DB|java\.\w+)"
)

# Filler phrases of templates.
FILLER = (
    "Lorem ipsum;Dies ist ein Blindtext;Blindtext, der später ersetzt;Platzhaltertext;Hier steht Ihr Text;Mustertext Mustertext;Überschrift hier eingeben;Text folgt in Kürze;"
    "Your text goes here;dummy copy that will be replaced;Enter headline here;Copy to follow;Sample text please insert;Add your description in this area;"
    "Votre texte ici;Ceci est un faux texte;Contenu à venir;texte factice;texte de remplissage;texte provisoire;Saisissez un titre;Saisir le titre;Texte à venir;Su texto aquí;texto de relleno que;Inserte un título;"
    "Introduzca un título;Introduzca aquí el título;Escriba aquí el título;Texto pendiente;Il tuo testo qui;testo segnaposto;Inserisci un titolo;Testo in arrivo;Hier komt uw tekst;opvultekst die;Voer hier een titel;"
    "Inhoud volgt;placeholder text"
)
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate "
    "velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit "
    "anim id est laborum"
).replace(" ", "")
MASH = frozenset("bla blah foo bar baz test testtext testtest dummy asdf asdfg qwertz qwerty jkl jklo xxx lorem ipsum".split())

# Titles that editors give to a new page.
EDITOR_TITLE = (
    r"(?:untitled(?: document| page)?(?: ?\d+)?|unbenannt(?:es dokument|e seite)?(?: ?\d+)?|neue seite ?\d*|new page ?\d*|nouvelle page ?\d*|"
    r"nueva p.{1,3}gina ?\d*|nuova pagina ?\d*|nieuwe pagina ?\d*|document sans (?:titre|nom)|documento (?:senza|sin) t.{1,4}t?ulo|documento senza titolo|naamloos document|naamloze pagina|"
    r"page title|your title here|titel der seite|seitentitel|titel hier|titre de la page|t.{1,3}tulo de la p.{1,3}gina|titolo della pagina|paginatitel|index(?:_neu|_new|_alt|_old|_test|_kopie|_copy)?[_-]?\d*|insert title here)"
)
# Names that templates give to their slots, with or without a joint.
SLOT_NAMES = frozenset(
    "name;ihrname;yourname;firma;firmenname;company;companyname;author;autor;ort;stadt;city;jahr;year;datum;date;title;titel;pagetitle;headline;"
    "sitename;contentblock;teasertext;firstname;lastname;itemdescription;inserttexthere;inserttitlehere;text;content;beschreibung;description;"
    "email;phone;url;logo;slogan;vorname;nachname;price;preis;product;produkt;username;votrenom;sunombre;tuonome;uwnaam".split(";")
)


def fragments(text: str) -> list[str]:
    """Skeletons of a ``;``-separated list, longest first."""
    return sorted({s for s in map(skeleton, text.split(";")) if s}, key=len, reverse=True)


def automaton(kinds: dict[str, str]) -> ahocorasick.Automaton:
    """Finds all fragments in a skeleton in one pass; values are ``(kind, length)``. The first kind of a shared fragment holds."""
    out = ahocorasick.Automaton()
    for kind, text in kinds.items():
        for x in fragments(text):
            if x not in out:
                out.add_word(x, (kind, len(x)))
    out.make_automaton()
    return out
