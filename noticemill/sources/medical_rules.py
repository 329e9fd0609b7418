"""Rule tables for medical-equipment notices. Plain data; operators take them as parameters."""

# The category taxonomy, in rule order (category, pattern).
TAXONOMY = [
    ("ULTRASOUND", (
        r"\b(?:pocus|ultra\s?sound|ultrasonograph\w*|usg|echo machine\w*|echocardiograph\w*"
        r"|doppler(?!\s+(?:radar|weather|traffic|industrial)\b)|sonograph\w*)\b"
    )),
    ("XRAY_DR", (
        r"\b(?:GM85(?: Fit)?|GC85|GF85|flat[ -]panel detectors?|(?:mobile|portable) dr(?: systems?"
        r"| units?)?|x[ -]?rays?|digital radiograph\w*|radiography|radiographic|dr system"
        r"|computed radiography)\b"
    )),
    ("C_ARM", r"\bc[ -]?arms?\b"),
    ("CT", (
        r"\b(?:BodyTom|OmniTom|(?:mobile|portable) ct|ct scanner|ct scan|computed tomography"
        r"|computerized tomography|multislice ct|\d+ ?slice ct)\b"
    )),
    ("DIAGNOSTIC_IMAGING", (
        r"\b(?:(?:medical|clinical|digital) fluoroscop\w*|fluoroscopy (?:machine\w*|system\w*"
        r"|equipment)|mri|magnetic resonance|mammograph\w*|digital mamography|breast tomosynthesis"
        r"|pet\s*[/-]?\s*ct|medical imaging)\b"
    )),
    ("PATIENT_MONITORING", (
        r"\b(?:patient monitor\w*|icu monitor\w*|multi[ -]?(?:parameter|para)(?:s)? monitor\w*"
        r"|vital[ -]?sign(?:s)? monitor\w*|central (?:monitoring|nursing) station|telemetry"
        r"|bedside monitor\w*|fetal monitor\w*|foetal monitor\w*|pulse oximeter\w*|capnograph\w*)\b"
    )),
    ("VENTILATION", (
        r"\b(?:HAMILTON[ -](?:C6|C3|C1|T1|MR1|EM7)|(?![^\n.;]{0,100}\b(?:hvac|industrial|exhaust|roof"
        r"|building ventilation)\b)ventilator\w*|mechanical ventilation|non[ -]?invasive ventilation"
        r"|icu ventilation)\b"
    )),
    ("RESPIRATORY", (
        r"\b(?:H900|hfnc|high[ -]flow nasal|high[ -]flow therapy|heated humidifiers?"
        r"|ventilator circuits?|flow sensors?|expiratory valves?|hmef|niv masks?|nasal cannulas?"
        r"|oxygen concentrator\w*|respiratory circuit\w*|breathing circuit\w*|nebulizer\w*"
        r"|nebuliser\w*|cpap|bipap|humidifier for (?:ventilator|respiratory))\b"
    )),
    ("ANAESTHESIA", (
        r"\b(?:(?:anaesthe\w*|anesthe\w*)\s+(?:(?:and )?euthanasia )?(?:workstations?|machines?"
        r"|systems?|equipment|apparatus|vapou?ri[sz]ers?)|vapou?ri[sz]er for anaesthesia)\b"
    )),
    ("PATIENT_WARMING", (
        r"\b(?![^\n.;]{0,100}\b(?:industrial|hvac"
        r"|laboratory water bath)\b)(?:patient warming (?:systems?|devices?|units?)|(?:forced[ -]air"
        r"|perioperative) (?:patient )?warming (?:systems?|devices?|units?)|(?:blood|infusion|iv"
        r"|intravenous) (?:and (?:blood|fluid) )?warmers?|(?:blood (?:and|&) )?fluid warmers?)\b"
    )),
    ("OT_LIGHTS", (
        r"\b(?:ot lights?|(?:operation|operating|surgical) (?:theatre |theater |room )?(?:lights?"
        r"|lamps?)|shadowless (?:surgical )?(?:lights?|lamps?))\b"
    )),
    ("INFUSION", (
        r"\b(?:Flo[ -]?Skan|infusion pump\w*|syringe pump\w*|syringe infusion pump\w*"
        r"|volumetric pump\w*|tci pump\w*|enteral feeding pump\w*|feeding pump\w*"
        r"|infusion workstation\w*|infusion system\w*)\b"
    )),
    ("ENDOSCOPY", (
        r"\b(?:TELE PACK|TELECAM|VITOM|ENDOMAT|endoscop\w*|chola\w*scop\w*|spy[ -]?glass"
        r"|insufflator\w*|suction irrigation|endoscopy camera\w*|endoscopy stack|exoscop\w*"
        r"|or integration|integrated operating room|video gastroscop\w*|colonoscope\w*"
        r"|gastroscope\w*)\b"
    )),
    ("LAPAROSCOPY", r"\b(?:laparoscop\w*|laparocator\w*)\b"),
    ("ARTHROSCOPY", r"\barthroscop\w*\b"),
    ("BRONCHOSCOPY", r"\bbronchoscop\w*\b"),
    ("UROLOGY_ENDOSCOPY", (
        r"\b(?:cystoscop\w*|ureteroscop\w*|u(?:retero|eretero)[ -]?renoscop\w*|resectoscop\w*"
        r"|hysteroscop\w*)\b"
    )),
    ("ENT_AIRWAY", (
        r"\b(?:C[ -]MAC|laryngoscop\w*|video[ -]?laryngoscop\w*|airway management|ent instrument\w*"
        r"|intubation kit\w*)\b"
    )),
    ("SURGICAL_INSTRUMENTS", (
        r"\b(?:surgical instrument\w*|surgical forceps|surgical scissors|surgical retractor\w*"
        r"|surgical trocar\w*|laparoscopic instrument\w*|orthopaedic instrument\w*"
        r"|orthopedic instrument\w*|orthop(?:a)?edic surgical equipment)\b"
    )),
    ("ELECTROSURGERY", r"\b(?:AUTOCON|electro[ -]?surg\w*|diathermy|(?:electro[ -]?)?cautery|vessel seal\w*)\b"),
    ("HOSPITAL_BEDS", (
        r"\b(?:hospital bed\w*|icu bed\w*|icu cots?|ward beds?|medical beds?|(?:five"
        r"|three)[ -]function beds?|clinical bed\w*|patient beds?(?![ -]*side\b)"
        r"|critical[ -]care bed\w*|med[ -]surg bed\w*|pa?ediatric bed\w*|bariatric bed\w*"
        r"|birthing bed\w*|obstetric bed\w*|smart bed\w*|electric (?:icu |hospital )?bed\w*"
        r"|motoris?zed hospital bed\w*|electric medical bed\w*)\b"
    )),
    ("STRETCHERS", (
        r"\b(?:stretcher\w*|patient transport trolley\w*|patient(?:s)? (?:transport "
        r"|shifting )?troll(?:ey|ie)s?)\b"
    )),
    ("PRESSURE_CARE", (
        r"\b(?:pressure care|anti[ -]decubitus|anti[ -]bedsore|pressure relieving mattress\w*"
        r"|pressure relief mattress\w*|alternating pressure mattress\w*|hospital mattress\w*"
        r"|air mattress for patients)\b"
    )),
    ("CARDIOLOGY_DIAGNOSTICS", r"\b(?:cardiac stress test|treadmill test system)\b"),
    ("ECG", r"\b(?:ecg|ekg|electrocardiograph\w*)\b"),
    ("HOLTER", r"\bholter\b"),
    ("ABPM", r"\b(?:abpm|ambulatory blood pressure)\b"),
    ("DEFIBRILLATION", (
        r"\b(?:defibrillator\w*|automated external defibrillat(?:ion|or)\w*|aed(?=\s+(?:defibrillator"
        r"|resuscitation|cardiac)\b)|aed(?=[^\n.;]{0,80}\b(?:clinical|hospital|patient|cardiac"
        r"|resuscitation|defibrillator)\b)|(?:clinical|hospital|patient|cardiac"
        r"|resuscitation)\b[^\n.;]{0,80}\baed)\b"
    )),
    ("LAB_IVD", (
        r"\b(?:ammonia kits? and controls[^\n]{0,80}\b(?:department of )?biochemistry"
        r"|consumables for (?:the )?(?:department|deptt?\.?) of biochemistry"
        r"|biochemistry reagent kits?|ivd|in[ -]vitro diagnostic\w*|biochemistry analy[sz]er\w*"
        r"|hematology analy[sz]er\w*|haematology analy[sz]er\w*|laboratory centrifuge\w*|microscope\w*"
        r"|elisa|pcr machine\w*|(?:blood gas|abg) analy[sz]er\w*)\b"
    )),
    ("COAGULATION", (
        r"\b(?:blood[ -]grouping(?: analy[sz]er\w*)?|(?:coagulation|ha?emostasis) (?:analy[sz]er\w*"
        r"|system\w*)|thromboelastograph\w*|teg system|teg analy[sz]er\w*)\b"
    )),
    ("MEDICAL_FURNITURE", (
        r"\b(?:hospital furniture|treatment chair\w*|examination (?:couch|table|chair)"
        r"|patient chair\w*|clinical chair\w*|dialysis chair\w*|blood donor chair\w*"
        r"|hospital trolley\w*|patient(?:s)? (?:shifting |transport )?troll(?:ey|ie)s?"
        r"|bedside cabinet\w*|medical trolley\w*|instrument trolley\w*|operating table\w*"
        r"|ot table\w*)\b"
    )),
    ("CONSUMABLES", (
        r"\b(?:catheter\w*|suture\w*|surgical glove\w*|medical syringe\w*|iv cannula\w*"
        r"|infusion set\w*|dialysis consumable\w*|endotracheal tube\w*)\b"
    )),
    ("ACCESSORIES", (
        r"\b(?:ventilator accessor\w*|endoscopy accessor\w*|patient monitor accessor\w*"
        r"|ecg electrode\w*|ultrasound probe\w*)\b"
    )),
    ("MEDICAL_IT", r"\b(?:pacs|radiology information system|hospital information system|dicom workstation\w*)\b"),
    ("OTHER_MEDICAL_EQUIPMENT", (
        r"\b(?:equip(?:ment|ement) for (?:the )?(?:department"
        r"|deptt?\.?) of (?:orthop(?:a)?edic surgery|pathology)|eeg machines?|electroencephalograph\w*"
        r"|pacemaker\w*|brachytherapy|radiotherapy equipment|medical equipments?|biopacemaker\w*"
        r"|radiant warmer|\bcrrt\b|nephelometer|spectrofluorometer|uv[ -]?(?:vis|visible).*spectro"
        r"|medical oxygen regulator|dialysis machine\w*|haemodialysis|hemodialysis|breast ?board\w*"
        r"|picc training|(?:training|medical) manne?quin\w*|(?:male )?iv arm training arm"
        r"|arterial arm trainer|heimlich abdominal thrust (?:training )?model"
        r"|(?:advance )?epidural(?: and lumbar puncture)? (?:training )?model"
        r"|lumbar puncture (?:training )?model|(?:automatic )?cpr (?:machines?|trainers?|manne?quins?)"
        r"|prosthetic\w*|colposcop\w*|suction (?:apparatus|machine|unit)|dvt pumps?|vte pumps?"
        r"|spirometers?|autoclave\w*|sterilizer\w*|steriliser\w*|incubator for neonat\w*)\b"
    )),
]

# Wording of scopes that are not medical products.
NON_PRODUCT_SCOPE = (
        r"\b(?:(?:weather|traffic|industrial) doppler|industrial (?:fluid )?warmers?|(?:industrial"
        r"|exhaust|roof|ceiling) ventilators?|industrial exhaust|civil repair|building repair"
        r"|building maintenance|building work|public works|repair and maintenance of building"
        r"|whitewash|white washing|painting|plaster|flooring|tiles?|false ceiling|door repair"
        r"|window repair|roof repair|waterproofing|masonry|carpentry|plumbing|sanitary work|drainage"
        r"|sewer|electrical wiring|cabling|(?:diesel|power|standby|electrical) generators?|hvac"
        r"|ac units?|air handling units?|fire fighting|boundary wall|electrical repair|electrical work"
        r"|electrical points|electrical works|electrical cabling|electrification|rewiring"
        r"|engineering works|building construction|road construction|renovation|air condition(?:er"
        r"|ing)|transformer|fire doors?|hostel furniture|office tables?|computer monitors?"
        r"|desktop monitors?|cctv monitors?|traffic monitoring|water pumps?|submersible pumps?"
        r"|centrifugal pumps?|sewage|sewerage|water treatment|water supply|office chairs?"
        r"|office furniture|office work\w*|office supplies|admission (?:notices?|forms?|applications?"
        r"|results?)|examination results?|course fees|lcd (?:display|panel|monitor)|road (?:works"
        r"|construction)|civil works?|dg set|diesel generator|stretcher elevators?"
        r"|passenger elevators?|stretcher lifts?|passenger lifts?|elevators?|lift maintenance"
        r"|elevator maintenance)\b"
    )

# Brand portfolios, in order. ``None`` means the portfolio has no such pattern.
PORTFOLIOS = [
    {
        "brand": "Samsung Healthcare",
        "aliases": r"\b(?:samsung(?: healthcare| medison)?)\b",
        "models": r"\b(?:R20|GM85(?: Fit)?|GC85|GF85|BodyTom|OmniTom|S[ -]Hub|SMART Center)\b",
        "ambiguous_models": r"^(?:R20|SMART Center)$",
        "clinical_terms": None,
        "categories": ["ULTRASOUND", "XRAY_DR", "CT"],
        "evidence": {"CT": r"\b(?:BodyTom|OmniTom|(?:mobile|portable) (?:ct|computed tomography))\b"},
        "exclusions": {},
        "needs_clinical_term": [],
    },
    {
        "brand": "Hamilton Medical",
        "aliases": r"\bhamilton(?: medical)?\b",
        "models": r"\b(?:HAMILTON[ -](?:C6|C3|C1|T1|MR1|EM7|HF90)|H900)\b",
        "ambiguous_models": None,
        "clinical_terms": (
        r"\b(?:hfnc|high[ -]flow nasal|heated humidifiers?|niv masks?|flow sensors?|expiratory valves?"
        r"|hmef|nasal cannulas?|ventilator circuits?|breathing circuits?|respiratory circuits?)\b"
    ),
        "categories": ["VENTILATION", "RESPIRATORY"],
        "evidence": {},
        "exclusions": {},
        "needs_clinical_term": ["RESPIRATORY"],
    },
    {
        "brand": "KARL STORZ",
        "aliases": r"\b(?:karl[ -]?storz|storz)\b",
        "models": r"\b(?:C[ -]MAC|HOPKINS|Rubina|IMAGE\s?1(?: S)?|TELE PACK|TELECAM|VITOM|AUTOCON|ENDOMAT|OR1)\b",
        "ambiguous_models": r"^(?:HOPKINS|Rubina|IMAGE\s?1(?: S)?|OR1)$",
        "clinical_terms": None,
        "categories": ["ENDOSCOPY", "LAPAROSCOPY", "ARTHROSCOPY", "BRONCHOSCOPY", "UROLOGY_ENDOSCOPY", "ENT_AIRWAY", "SURGICAL_INSTRUMENTS", "ELECTROSURGERY"],
        "evidence": {},
        "exclusions": {"ENDOSCOPY": r"\bspy[ -]?glass\b"},
        "needs_clinical_term": [],
    },
    {
        "brand": "LINET",
        "aliases": r"\blinet\b",
        "models": (
        r"\b(?:Multicare(?: X)?|Eleganza|Essenza|Sprint|AVE 2|TOM 2|Air2Care|Virtuoso|OptiCare"
        r"|HybriMatt|SafeSense)\b"
    ),
        "ambiguous_models": r"^(?:Sprint|Virtuoso|OptiCare|SafeSense)$",
        "clinical_terms": (
        r"\b(?:bedside cabinets?|patient transport trolleys?|medical trolleys?|patient chairs?"
        r"|dialysis chairs?|blood donor chairs?|clinical chairs?|treatment chairs?|examination chairs?"
        r"|hospital furniture)\b"
    ),
        "categories": ["HOSPITAL_BEDS", "STRETCHERS", "PRESSURE_CARE", "MEDICAL_FURNITURE"],
        "evidence": {},
        "exclusions": {},
        "needs_clinical_term": ["MEDICAL_FURNITURE"],
    },
    {
        "brand": "Medcaptain",
        "aliases": r"\bmedcaptain\b",
        "models": None,
        "ambiguous_models": None,
        "clinical_terms": (
        r"\b(?:infusion sets?|(?:dvt|vte) pumps?|spirometers?|closed[ -]suction catheters?"
        r"|blood[ -]grouping(?: analy[sz]ers?)?)\b"
    ),
        "categories": ["INFUSION", "ANAESTHESIA", "ENT_AIRWAY", "COAGULATION", "BRONCHOSCOPY"],
        "evidence": {},
        "exclusions": {},
        "needs_clinical_term": [],
    },
    {
        "brand": "Spacelabs Healthcare",
        "aliases": r"\bspace ?labs(?: healthcare)?\b",
        "models": (
        r"\b(?:Xprezzon|Qube(?: Mini)?|AriaTele|Xhibit|Sentinel|OnTrak|Eclipse|Evo|Lifecard"
        r"|CardioPulse|CardioExpress)\b"
    ),
        "ambiguous_models": r"^(?:Qube(?: Mini)?|Sentinel|Eclipse|Evo)$",
        "clinical_terms": None,
        "categories": ["PATIENT_MONITORING", "ECG", "HOLTER", "ABPM", "CARDIOLOGY_DIAGNOSTICS"],
        "evidence": {},
        "exclusions": {},
        "needs_clinical_term": [],
    },
    {
        "brand": "Skanray",
        "aliases": r"\bskan[ -]?ray\b",
        "models": r"\b(?:Tru[ -]?SKAN(?: i10| i12)?|Athena(?: 500i| SV200)?|SkanSiesta Pro|Flo[ -]?Skan)\b",
        "ambiguous_models": r"^Athena$",
        "clinical_terms": None,
        "categories": ["VENTILATION", "XRAY_DR", "C_ARM", "PATIENT_MONITORING", "ANAESTHESIA", "ECG", "DEFIBRILLATION", "ELECTROSURGERY", "INFUSION"],
        "evidence": {},
        "exclusions": {},
        "needs_clinical_term": [],
    },
]

# Priority groups, in order (group, label, categories, aliases).
PRIORITY_GROUPS = [
    ("VENTILATORS", "Ventilators", ["VENTILATION"], (
        r"\b(?:ventilator\w*|mechanical ventilation(?: system)?|(?:non[ -]?invasive|icu) ventilation"
        r"|(?:icu|critical care|respiratory) respiratory equipment|respiratory support equipment|hfnc"
        r"|high[ -]flow nasal cannula|high flow oxygen therapy)\b"
    )),
    ("ULTRASOUND", "Ultrasound", ["ULTRASOUND"], (
        r"\b(?:ultra\s?sound|ultrasonograph\w*|usg|(?:(?:colou?r|vascular|portable|handheld) )?doppler"
        r"|echocardiograph\w*|echo machines?|pocus)\b"
    )),
    ("DEFIBRILLATORS", "Defibrillators", ["DEFIBRILLATION"], r"\b(?:defibrillator\w*|automated external defibrillator|aed|cardiac resuscitation equipment)\b"),
    ("HOSPITAL_BEDS", "Hospital beds", ["HOSPITAL_BEDS", "STRETCHERS", "PRESSURE_CARE"], (
        r"\b(?:(?:icu|critical[ -]care|hospital|patient|medical|ward|med[ -]surg|bariatric|pa?ediatric"
        r"|birthing|obstetric|motorized|motorised|five[ -]function|three[ -]function) (?:beds?|cots?)"
        r"|stretcher\w*|(?:patient|emergency) troll(?:ey|ie)s?|anti[ -]decubitus mattress"
        r"|pressure relief mattress|alternating pressure mattress)\b"
    )),
    ("ENDOSCOPY", "Endoscopy", ["ENDOSCOPY", "LAPAROSCOPY", "ARTHROSCOPY", "BRONCHOSCOPY", "UROLOGY_ENDOSCOPY"], (
        r"\b(?:endoscop\w*|gastroscop\w*|colonoscop\w*|duodenoscop\w*|ercp scope|bronchoscop\w*"
        r"|laparoscop\w*|laparocator\w*|arthroscop\w*|hysteroscop\w*|cystoscop\w*|ureteroscop\w*"
        r"|u(?:retero|eretero)[ -]?renoscop\w*|video[ -]?laryngoscop\w*|c[ -]mac"
        r"|(?:co2 )?insufflator\w*|automated endoscope reprocessor|icg imaging|nir imaging)\b"
    )),
    ("MAMMOGRAPHY", "Mammography", ["DIAGNOSTIC_IMAGING"], r"\b(?:mammograph\w*|digital mamography|breast tomosynthesis)\b"),
    ("DIGITAL_RADIOGRAPHY", "Digital radiography / Mobile DR", ["XRAY_DR"], (
        r"\b(?:digital radiograph\w*|digital x[ -]?ray\w*|(?:mobile|portable) dr(?: systems?| units?)?"
        r"|dr systems?|computed radiography|flat[ -]panel detectors?|GM85(?: Fit)?|GC85|GF85)\b"
    )),
    ("C_ARM", "C-arm", ["C_ARM"], r"\bc[ -]?arms?\b"),
    ("INFUSION_PUMPS", "Syringe / Infusion pumps", ["INFUSION"], (
        r"\b(?:Flo[ -]?Skan|(?:syringe(?: infusion)?|infusion|volumetric|tci) pumps?"
        r"|infusion workstations?)\b"
    )),
    ("PATIENT_MONITORS", "Patient monitors", ["PATIENT_MONITORING"], (
        r"\b(?:(?:patient|icu|bedside|vital[ -]?signs?|multi[ -]?(?:parameter|para)s?) monitors?"
        r"|central monitors?|central (?:monitoring|nursing) stations?)\b"
    )),
    ("PATIENT_WARMING", "Patient / Fluid warmers", ["PATIENT_WARMING"], (
        r"\b(?:patient warming (?:systems?|devices?|units?)|(?:forced[ -]air"
        r"|perioperative) (?:patient )?warming (?:systems?|devices?|units?)|(?:blood|infusion|iv"
        r"|intravenous) (?:and (?:blood|fluid) )?warmers?|(?:blood (?:and|&) )?fluid warmers?)\b"
    )),
    ("OT_LIGHTS", "OT lights", ["OT_LIGHTS"], (
        r"\b(?:ot lights?|(?:operation|operating|surgical) (?:theatre |theater |room )?(?:lights?"
        r"|lamps?)|shadowless (?:surgical )?(?:lights?|lamps?))\b"
    )),
    ("ANAESTHESIA", "Anaesthesia machines", ["ANAESTHESIA"], r"\b(?:anaesthe\w*|anesthe\w*) (?:workstations?|machines?|systems?|equipment|apparatus)\b"),
]

# Titles too broad to name one product.
GENERIC_SCOPE = (
        r"\b(?:(?:icu|critical[ -]care|life support|medical|respiratory|radiology|diagnostic imaging"
        r"|imaging|ot|surgical|gastroenterology|urology|ent|emergency|resuscitation|crash cart"
        r"|minimally invasive surgery) (?:equipment|equipments|package|systems?)|(?:hospital"
        r"|critical care|medical) furniture)\b"
    )

# Clause rules, in order (section, field, pattern).
CLAUSE_RULES = [
    ("technicalRequirements", "Radiography and mammography", (
        r"\b(?:anode|focal spot|tube current|tube voltage|kvp|mas|automatic exposure control|aec"
        r"|dose area product|dap|detective quantum efficiency|dqe|pixel pitch|detector size"
        r"|compression force|breast tomosynthesis|tomosynthesis|anti.scatter grid)\b"
    )),
    ("technicalRequirements", "C-arm and mobile imaging", (
        r"\b(?:c.arm|orbital rotation|angulation|isocentric|image intensifier|flat.panel detector"
        r"|pulsed fluoroscopy|mobile dr|portable dr|wireless detector)\b"
    )),
    ("technicalRequirements", "Infusion and syringe delivery", (
        r"\b(?:infusion rate|flow rate|bolus|occlusion pressure|occlusion alarm|syringe sizes?"
        r"|syringe compatibility|drug library|dose error reduction|anti.bolus|anti.free.flow"
        r"|keep vein open|kvo|infusion accuracy)\b"
    )),
    ("technicalRequirements", "Patient and fluid warming", (
        r"\b(?:patient warming|fluid warmer|blood warmer|forced.air warming|warming blankets?"
        r"|warming temperature|temperature range|over.temperature|overheating|heating rate)\b"
    )),
    ("technicalRequirements", "Surgical illumination", (
        r"\b(?:lux|illuminance|illumination intensity|colou?r rendering index|cri|light.field diameter"
        r"|shadow dilution|shadowless|surgical light|ot light|sterili[sz]able handles?)\b"
    )),
    ("technicalRequirements", "Anaesthesia delivery", (
        r"\b(?:anaesthesia machine|anesthesia machine|anaesthesia workstation|anesthesia workstation"
        r"|vapou?ri[sz]er|fresh gas flow|gas mixer|low.flow anaesthesia|low.flow anesthesia"
        r"|hypoxic guard|breathing system|carbon dioxide absorber|co2 absorber)\b"
    )),
    ("technicalRequirements", "Airway visualization", (
        r"\b(?:video laryngoscope|intubation bronchoscope|insertion tube|working channel|angulation"
        r"|field of view|depth of field|laryngoscope blades?)\b"
    )),
    ("technicalRequirements", "Patient population", r"\b(?:adult|pa?ediatric|neonatal|infant)\b"),
    ("technicalRequirements", "Ventilation modes", (
        r"\b(?:vcv|pcv|simv|psv|cpap|bipap|prvc|aprv|niv(?:-st)?|hfnc|volume control|pressure control"
        r"|pressure support|volume support|spontaneous ventilation|adaptive ventilation|closed.loop"
        r"|apn(?:ea|oea) backup|recruitment man)\b"
    )),
    ("technicalRequirements", "Ventilation parameters", (
        r"\b(?:tidal volume|respiratory rate|peep|fio2|i:e ratio|inspiratory (?:time|pressure"
        r"|flow(?: rate)?)|trigger sensitivity|minute volume)\b"
    )),
    ("technicalRequirements", "Monitoring", (
        r"\b(?:etco2|spo2|nibp|ibp|airway pressure|ppeak|pmean|pplat|(?:lung|dynamic"
        r"|static) compliance|airway resistance|pressure.volume loop|flow.volume loop|trends"
        r"|temperature monitoring)\b"
    )),
    ("technicalRequirements", "Battery", r"\b(?:battery|batteries|hot.swappable|shock count|charge time)\b"),
    ("technicalRequirements", "Gas supply", (
        r"\b(?:oxygen hose|medical air hose|nist|diss|pipeline pressure|compressed.air|turbine"
        r"|compressor|paramagnetic|galvanic|fuel cell)\b"
    )),
    ("technicalRequirements", "Alarms", r"\b(?:alarm|disconnection|gas supply failure)\b"),
    ("technicalRequirements", "Ultrasound probes", (
        r"\b(?:convex|curvilinear|linear probe|phased array|endocavitary|transvaginal|tvs|transrectal"
        r"|microconvex|matrix probe|volume probe|tee probe|transducer|active ports)\b"
    )),
    ("technicalRequirements", "Ultrasound imaging modes", (
        r"\b(?:b.mode|m.mode|colou?r doppler|power doppler|pw doppler|cw doppler|tissue doppler"
        r"|spectral doppler)\b"
    )),
    ("technicalRequirements", "Advanced imaging", (
        r"\b(?:elastograph\w*|ceus|3d|4d|stic|needle guidance|needle enhancement|fusion imaging"
        r"|microvascular|auto imt|auto ef|speckle reduction|compound imaging|fluorescence|icg|nir|nbi"
        r"|chromoendoscopy)\b"
    )),
    ("technicalRequirements", "Display and image technology", (
        r"\b(?:screen|display|resolution|touchscreen|medical.grade monitor|full hd|4k|cmos|ccd|3.chip"
        r"|camera head)\b"
    )),
    ("technicalRequirements", "Data and connectivity", (
        r"\b(?:dicom|pacs|usb|ssd|storage|network|event review|code summary|nurse.call integration"
        r"|bed monitoring)\b"
    )),
    ("technicalRequirements", "Defibrillation", r"\b(?:biphasic|monophasic|energy steps|max\w* energy|joules|cardioversion|manual mode|aed mode)\b"),
    ("technicalRequirements", "Pacing", r"\b(?:pacing|transcutaneous|demand mode|fixed mode)\b"),
    ("technicalRequirements", "ECG", r"\b(?:3.lead|5.lead|12.lead|ecg|ekg)\b"),
    ("technicalRequirements", "Bed platform and functions", (
        r"\b(?:[345].section|mattress sections?|motorized|motorised|actuator|backrest|knee rest"
        r"|height adjustment|trendelenburg|chair position|cardiac chair|auto contour|one.touch cpr"
        r"|manual cpr|electric cpr|side rails?|castors?|central locking|directional lock"
        r"|safe working load|swl|patient capacity|bed.exit|brake alarm|weighing scale"
        r"|angle indicators)\b"
    )),
    ("technicalRequirements", "Endoscopy system", (
        r"\b(?:gastroscope|colonoscope|duodenoscope|bronchoscope|cystoscope|ureteroscope|hysteroscope"
        r"|arthroscope|laparoscope|flexible scope|rigid scope|image processor|video processor"
        r"|endoscopy processor|light source|insufflat\w*|irrigation pump|arthroscopy pump"
        r"|smoke evacuation|hf generator|electrosurgical generator|monopolar|bipolar|vessel sealing)\b"
    )),
    ("accessories", "Accessories and quantities", (
        r"\b(?:accessor\w*|humidif\w*|flow sensors?|expiratory (?:valve|cassette)|support arm|trolley"
        r"|mounting bracket|paddles?|multifunction pads?|defibrillation pads?|pacing pads?|cuffs?"
        r"|printer|ups|isolation transformer|gel warmer|probe holders?|biopsy guide|iv pole"
        r"|lifting pole|cylinder holder|urine bag holder|drainage holder|monitor shelf|linen shelf"
        r"|bed extension|bumper|(?:biopsy|alligator|triprong) forceps|path finder|formalin chamber"
        r"|cleaning adapt(?:er|or)|snares?|injection needles?|graspers?|retrieval baskets?|guidewires?"
        r"|suction valves?|air.water valves?|biopsy valves?|cleaning adapters?|leak tester|aer"
        r"|automated endoscope reprocessor|washing unit|drying cabinet|scope (?:storage )?cabinet"
        r"|cleaning brushes)\b"
    )),
    ("consumables", "Consumables", (
        r"\b(?:consumable\w*|breathing circuits?|heated wire|disposable chamber|full face mask"
        r"|oronasal mask|nasal mask|nasal pillows|headgear|bacterial filter|viral filter|hmef?|hepa"
        r"|inspiratory filter|expiratory filter|printer paper|mattress|air cells|cleaning brush"
        r"|detergent)\b"
    )),
    ("warranty", "Warranty", r"\b(?:warranty|guarantee period)\b"),
    ("cmc", "CMC / AMC duration and coverage", (
        r"\b(?:cmc|camc|amc|comprehensive maintenance|annual maintenance|after warranty"
        r"|spares? included|labou?r included|consumables excluded|accessories excluded)\b"
    )),
    ("serviceRequirements", "Lifecycle support", (
        r"\b(?:uptime|down.?time|response time|breakdown|preventive maintenance|penalt\w*|standby"
        r"|software upgrade|firmware upgrade|service (?:engineer|centre|center)|bending rubber"
        r"|insertion tube|biopsy channel|light guide bundle|control body)\b"
    )),
    ("regulatoryRequirements", "Regulatory requirements", (
        r"\b(?:cdsco|bis|iso(?: 13485)?|ce certif\w*|ce mark\w*|ce(?=\s+(?:and|or|approved|required"
        r"|certified))|us ?fda|fda(?: 510)?|iec 60601(?:-2-4)?|nabl|aerb)\b"
    )),
    ("bidderEligibility", "Bidder eligibility", (
        r"\b(?:turnover|past experience|similar supply|performance certificates?|oem"
        r"|manufacturer authori[sz]ation|\bmaf\b|installed base|number of installations"
        r"|years in manufacturing|non.blacklist\w*|gst|pan registration|pan no|msme|mse relaxation"
        r"|make in india|class.i local supplier|class.ii local supplier|local content)\b"
    )),
    ("delivery", "Delivery, installation and training", (
        r"\b(?:delivery (?:period|within|schedule|time|days)|installation|commissioning|site readiness"
        r"|site modification|training|demonstration|sample requirement|proof.of.concept)\b"
    )),
    ("commercialTerms", "Commercial terms", (
        r"\b(?:emd|bid security|pbg|performance (?:security|guarantee)|bid validity|bid offer validity"
        r"|payment|retention|delivery location|exemption)\b"
    )),
    ("quantity", "Quantity / line items", r"\b(?:total quantity|quantity|qty|\d+\s*(?:units?|nos\.?|pieces?|sets?))\b"),
]

# Sections in display order (section, label).
SECTIONS = [
    ("quantity", "Quantity / line items"),
    ("technicalRequirements", "Technical specifications"),
    ("accessories", "Accessories"),
    ("consumables", "Consumables"),
    ("warranty", "Warranty"),
    ("cmc", "CMC / AMC"),
    ("serviceRequirements", "Lifecycle support"),
    ("regulatoryRequirements", "Regulatory requirements"),
    ("bidderEligibility", "Bidder eligibility"),
    ("delivery", "Delivery, installation & training"),
    ("commercialTerms", "Commercial terms"),
]

# Search terms per priority group, in order.
SEARCH_TERMS = [
    ("VENTILATORS", ["ventilator", "mechanical ventilation", "neonatal ventilator", "portable ventilator"]),
    ("ULTRASOUND", ["ultrasound", "doppler", "echocardiography", "ultrasonography"]),
    ("DEFIBRILLATORS", ["defibrillator", "automated external defibrillator"]),
    ("HOSPITAL_BEDS", ["hospital bed", "icu bed", "stretcher", "patient trolley"]),
    ("ENDOSCOPY", ["endoscopy", "laryngoscope", "bronchoscope", "gastroscope", "colonoscope", "flexible intubation"]),
    ("MAMMOGRAPHY", ["mammography", "mamography", "breast tomosynthesis"]),
    ("DIGITAL_RADIOGRAPHY", ["digital radiography", "digital x ray", "mobile dr", "flat panel detector", "computed radiography"]),
    ("C_ARM", ["c arm", "c-arm"]),
    ("INFUSION_PUMPS", ["syringe pump", "infusion pump"]),
    ("PATIENT_MONITORS", ["multiparameter", "multipara monitor", "patient monitor", "vital sign monitor", "central monitor", "central monitoring station"]),
    ("PATIENT_WARMING", ["patient warming", "fluid warmer", "blood warmer", "forced air warming"]),
    ("OT_LIGHTS", ["ot light", "operation theatre light", "surgical light", "shadowless light"]),
    ("ANAESTHESIA", ["anaesthesia machine", "anesthesia machine", "anaesthesia workstation", "anesthesia workstation"]),
]
