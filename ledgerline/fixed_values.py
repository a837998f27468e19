"""Fixed values that must equal the behaviour being reproduced.

FIXED VALUES — business rules and lookup tables, stated as plain data in their
natural order. They are configuration: every operator takes them as a parameter
and these are only the defaults.
"""

# FIXED VALUES: placeholders written into STATE / CITY when unknown.
STATE_PLACEHOLDER = "State Not Found"
CITY_PLACEHOLDER = "City Not Found"
FY_UNKNOWN = "UNKNOWN"

# FIXED VALUES: GST rule — seller's home state and the total GST rate.
HOME_STATE = "MAHARASHTRA"
TAX_RATE = "0.18"  # kept as text so Decimal arithmetic stays exact
INTRA_STATE_EXTRA = ["UNKNOWN", "STATE NOT FOUND"]

# FIXED VALUES: tax/total columns dropped before recomputing taxes.
STALE_TAX_COLUMNS = [
    "TOTALAMOUNT", "TAX", "IGST", "CGST", "SGST",
    "IGST_RATE", "CGST_RATE", "SGST_RATE",
    "GRAND_TOTAL", "NET_AMOUNT", "TOTAL_TAX", "ROUND_OFF",
]

# FIXED VALUES: material-group exclusion keywords (substring, case-insensitive).
EXCLUDE_KEYWORDS = [
    "SERVICE", "AIR VENT", "PACKING", "RAW", "BRASS", "PANEL",
    "SALES ACCOUNT", "MASTER BATCH", "SEMI", "PPCP", "FIXED",
    "PROTECTION", "HIPS", "ABS", "INDIRECT", "NYLOAN", "PP BLACK",
    "NASER MILES PARIS", "DOCUMENT HOLDER",
    "SWISS MILITARY MODLE MAZE",
    "SELF ADHESIVE TIE MOUNT", "SCREW TYPE TIE MOUNT",
    "FINISHED GOOD",
]

# FIXED VALUES: ordered material-group mapping rules (regex -> canonical name),
# applied in this order, case-insensitive; later rules see earlier results.
MATERIAL_GROUP_MAPPINGS = [
    ("CONDUIT.*GLAND", "POLYAMIDE CONDUIT GLAND"),
    ("REVER", "REVERSE FORWARD"),
    ("REVERSE FORWORD", "REVERSE FORWARD"),
]

# FIXED VALUES: material-group column candidates, first present wins.
MATERIAL_GROUP_CANDIDATES = [
    "ITEM_NAME_GROUP", "MATERIALGROUP", "MATERIAL_GROUP", "PRODUCT_CATEGORY", "CATEGORY", "ITEM_GROUP",
    "item_name_group", "materialgroup", "material_group", "product_category", "category", "item_group",
]

# FIXED VALUES: header synonym rules, evaluated in this order per column.
# (target, substrings); INVOICE_NO also takes an exact "NO", never a DATE column; ITEMNAME never a GROUP column.
HEADER_SYNONYMS = [
    ("CITY", ["CITY", "TOWN", "DISTRICT", "LOCATION", "STATION", "DESTINATION", "PLACE"]),
    ("STATE", ["STATE", "REGION", "PROVINCE", "TERRITORY", "POS", "SUPPLY"]),
    ("CUSTOMER_NAME", ["CUSTOMER", "PARTY", "BILL TO", "BUYER", "DEBTOR"]),
    ("ITEMNAME", ["ITEM", "MATERIAL", "PRODUCT", "DESCRIPTION", "PART"]),
    ("INVOICE_NO", ["INVOICE", "BILL_NO", "DOC_NO", "VOUCHER"]),
]
REGION_COLUMNS = ["REGION", "PROVINCE", "TERRITORY"]

# FIXED VALUES: preferred column order for the snapshot table.
PREFERRED_ORDER = ["DATE", "MONTH", "FINANCIAL_YEAR", "INVOICE_NO", "CUSTOMER_NAME", "ITEMNAME", "QTY", "RATE", "AMOUNT"]

# FIXED VALUES: city -> state fallback map (one key appears twice in the source
# with the same value; listed once here).
CITY_STATE_MAP = [
    ("MUMBAI", "MAHARASHTRA"), ("PUNE", "MAHARASHTRA"), ("NAGPUR", "MAHARASHTRA"),
    ("NASHIK", "MAHARASHTRA"), ("THANE", "MAHARASHTRA"), ("AURANGABAD", "MAHARASHTRA"),
    ("DELHI", "DELHI"), ("NEW DELHI", "DELHI"), ("GURGAON", "HARYANA"),
    ("NOIDA", "UTTAR PRADESH"), ("BANGALORE", "KARNATAKA"), ("BENGALURU", "KARNATAKA"),
    ("CHENNAI", "TAMIL NADU"), ("HYDERABAD", "TELANGANA"), ("KOLKATA", "WEST BENGAL"),
    ("AHMEDABAD", "GUJARAT"), ("SURAT", "GUJARAT"), ("VADODARA", "GUJARAT"),
    ("JAIPUR", "RAJASTHAN"), ("LUCKNOW", "UTTAR PRADESH"), ("KANPUR", "UTTAR PRADESH"),
    ("INDORE", "MADHYA PRADESH"), ("BHOPAL", "MADHYA PRADESH"), ("VAPI", "GUJARAT"),
    ("CHANDIGARH", "CHANDIGARH"), ("SECUNDERABAD", "TELANGANA"), ("PANVEL", "MAHARASHTRA"),
    ("BHIWANDI", "MAHARASHTRA"), ("VASAI", "MAHARASHTRA"), ("RAJKOT", "GUJARAT"),
    ("HOSUR", "TAMIL NADU"),
]

# FIXED VALUES: country centroid used when a state has no coordinates.
DEFAULT_COORDS = (20.5937, 78.9629)

# FIXED VALUES: state coordinates (lat, lon) by title-cased state name.
STATE_COORDS = [
    ("Maharashtra", 19.7515, 75.7139), ("Delhi", 28.7041, 77.1025), ("Karnataka", 15.3173, 75.7139),
    ("Gujarat", 22.2587, 71.1924), ("Tamil Nadu", 11.1271, 78.6569), ("Uttar Pradesh", 26.8467, 80.9462),
    ("West Bengal", 22.9868, 87.8550), ("Telangana", 18.1124, 79.0193), ("Rajasthan", 27.0238, 74.2179),
    ("Madhya Pradesh", 22.9734, 78.6569), ("Haryana", 29.0588, 76.0856), ("Bihar", 25.0961, 85.3131),
    ("Punjab", 31.1471, 75.3412), ("Kerala", 10.8505, 76.2711), ("Andhra Pradesh", 15.9129, 79.7400),
    ("Odisha", 20.9517, 85.0985), ("Jharkhand", 23.6102, 85.2799), ("Chhattisgarh", 21.2787, 81.8661),
    ("Assam", 26.2006, 92.9376), ("Uttarakhand", 30.0668, 79.0193), ("Himachal Pradesh", 31.1048, 77.1734),
    ("Tripura", 23.9408, 91.9882), ("Meghalaya", 25.4670, 91.3662), ("Manipur", 24.6637, 93.9063),
    ("Nagaland", 26.1584, 94.5624), ("Goa", 15.2993, 74.1240), ("Arunachal Pradesh", 28.2180, 94.7278),
    ("Mizoram", 23.1645, 92.9376), ("Sikkim", 27.5330, 88.5122), ("Chandigarh", 30.7333, 76.7794),
]

# FIXED VALUES: city coordinates (lat, lon) by upper-case city name.
CITY_COORDS = [
    ("MUMBAI", 19.0760, 72.8777), ("PUNE", 18.5204, 73.8567), ("NAGPUR", 21.1458, 79.0882),
    ("NASHIK", 19.9975, 73.7898), ("THANE", 19.2183, 72.9781), ("AURANGABAD", 19.8762, 75.3433),
    ("SOLAPUR", 17.6599, 75.9064), ("AMRAVATI", 20.9320, 77.7523), ("KOLHAPUR", 16.7050, 74.2433),
    ("AKOLA", 20.7002, 77.0082), ("JALGAON", 21.0077, 75.5626), ("LATUR", 18.4088, 76.5604),
    ("DHULE", 20.9042, 74.7749), ("AHMEDNAGAR", 19.0952, 74.7496), ("CHANDRAPUR", 19.9615, 79.2961),
    ("PARBHANI", 19.2644, 76.7855), ("SANGLI", 16.8524, 74.5815), ("NANDED", 19.1383, 77.3210),
    ("MALEGAON", 20.5579, 74.5089), ("JALNA", 19.8347, 75.8816), ("BEED", 18.9891, 75.7601),
    ("BANGALORE", 12.9716, 77.5946), ("BENGALURU", 12.9716, 77.5946), ("MYSORE", 12.2958, 76.6394),
    ("HUBLI", 15.3647, 75.1240), ("DHARWAD", 15.4589, 75.0078), ("MANGALORE", 12.9141, 74.8560),
    ("BELGAUM", 15.8497, 74.4977), ("GULBARGA", 17.3297, 76.8343), ("DAVANAGERE", 14.4644, 75.9218),
    ("BELLARY", 15.1394, 76.9214), ("BIJAPUR", 16.8302, 75.7100), ("SHIMOGA", 13.9299, 75.5681),
    ("TUMKUR", 13.3392, 77.1018), ("UDUPI", 13.3409, 74.7421), ("BIDAR", 17.9104, 77.5199),
    ("CHENNAI", 13.0827, 80.2707), ("COIMBATORE", 11.0168, 76.9558), ("MADURAI", 9.9252, 78.1198),
    ("TIRUCHIRAPPALLI", 10.7905, 78.7047), ("SALEM", 11.6643, 78.1460), ("TIRUNELVELI", 8.7139, 77.7567),
    ("TIRUPPUR", 11.1085, 77.3411), ("THOOTHUKUDI", 8.7642, 78.1348), ("NAGERCOIL", 8.1833, 77.4119),
    ("THANJAVUR", 10.7870, 79.1378), ("DINDIGUL", 10.3673, 77.9803), ("VELLORE", 12.9165, 79.1325),
    ("CUDDALORE", 11.7480, 79.7714), ("KANCHIPURAM", 12.8185, 79.6947), ("ERODE", 11.3410, 77.7172),
    ("AHMEDABAD", 23.0225, 72.5714), ("SURAT", 21.1702, 72.8311), ("VADODARA", 22.3072, 73.1812),
    ("RAJKOT", 22.3039, 70.8022), ("BHAVNAGAR", 21.7645, 72.1519), ("JAMNAGAR", 22.4707, 70.0577),
    ("JUNAGADH", 21.5222, 70.4579), ("GANDHINAGAR", 23.2156, 72.6369), ("ANAND", 22.5645, 72.9289),
    ("NAVSARI", 20.9467, 72.9520), ("MORBI", 22.8116, 70.8239), ("NADIAD", 22.6916, 72.8634),
    ("BHARUCH", 21.7051, 72.9959), ("PORBANDAR", 21.6417, 69.6293), ("MEHSANA", 23.5880, 72.3693),
    ("LUCKNOW", 26.8467, 80.9462), ("KANPUR", 26.4499, 80.3319), ("VARANASI", 25.3176, 82.9739),
    ("AGRA", 27.1767, 78.0081), ("MEERUT", 28.9845, 77.7064), ("GHAZIABAD", 28.6692, 77.4538),
    ("PRAYAGRAJ", 25.4358, 81.8463), ("ALLAHABAD", 25.4358, 81.8463), ("BAREILLY", 28.3670, 79.4304),
    ("ALIGARH", 27.8974, 78.0880), ("MORADABAD", 28.8386, 78.7733), ("SAHARANPUR", 29.9640, 77.5448),
    ("GORAKHPUR", 26.7606, 83.3732), ("NOIDA", 28.5355, 77.3910), ("FIROZABAD", 27.1593, 78.3957),
    ("JHANSI", 25.4484, 78.5685), ("MUZAFFARNAGAR", 29.4727, 77.7085), ("MATHURA", 27.4924, 77.6737),
    ("HYDERABAD", 17.3850, 78.4867), ("WARANGAL", 17.9689, 79.5941), ("NIZAMABAD", 18.6725, 78.0941),
    ("KARIMNAGAR", 18.4386, 79.1288), ("KHAMMAM", 17.2473, 80.1514), ("RAMAGUNDAM", 18.8007, 79.4447),
    ("VISAKHAPATNAM", 17.6868, 83.2185), ("VIJAYAWADA", 16.5062, 80.6480), ("GUNTUR", 16.3067, 80.4365),
    ("NELLORE", 14.4426, 79.9865), ("KURNOOL", 15.8281, 78.0373), ("TIRUPATI", 13.6288, 79.4192),
    ("RAJAHMUNDRY", 16.9891, 81.7839), ("KAKINADA", 16.9604, 82.2381), ("ANANTAPUR", 14.6819, 77.6006),
    ("JAIPUR", 26.9124, 75.7873), ("JODHPUR", 26.2389, 73.0243), ("KOTA", 25.2138, 75.8648),
    ("BIKANER", 28.0229, 73.3119), ("AJMER", 26.4499, 74.6399), ("UDAIPUR", 24.5854, 73.7125),
    ("BHILWARA", 25.3216, 74.5861), ("ALWAR", 27.5530, 76.6346), ("SRI GANGANAGAR", 29.9045, 73.8776),
    ("INDORE", 22.7196, 75.8577), ("BHOPAL", 23.2599, 77.4126), ("JABALPUR", 23.1815, 79.9864),
    ("GWALIOR", 26.2183, 78.1828), ("UJJAIN", 23.1793, 75.7849), ("SAGAR", 23.8388, 78.7378),
    ("DEWAS", 22.9676, 76.0534), ("SATNA", 24.6005, 80.8322), ("RATLAM", 23.3315, 75.0367),
    ("KOLKATA", 22.5726, 88.3639), ("HOWRAH", 22.5958, 88.2636), ("SILIGURI", 26.7271, 88.3953),
    ("DURGAPUR", 23.5204, 87.3119), ("ASANSOL", 23.6739, 86.9524), ("BHUBANESWAR", 20.2961, 85.8245),
    ("CUTTACK", 20.4625, 85.8828), ("PATNA", 25.0961, 85.3131), ("GAYA", 24.7914, 85.0002),
    ("RANCHI", 23.3441, 85.3096), ("JAMSHEDPUR", 22.8046, 86.2029), ("DHANBAD", 23.7957, 86.4304),
    ("GUWAHATI", 26.1445, 91.7362), ("AGARTALA", 23.8315, 91.2868), ("SHILLONG", 25.5788, 91.8933),
    ("DELHI", 28.7041, 77.1025), ("NEW DELHI", 28.6139, 77.2090), ("CHANDIGARH", 30.7333, 76.7794),
    ("LUDHIANA", 30.9010, 75.8573), ("AMRITSAR", 31.6340, 74.8723), ("JALANDHAR", 31.3260, 75.5762),
    ("PATIALA", 30.3398, 76.3869), ("FARIDABAD", 28.4089, 77.3178), ("GURGAON", 28.4595, 77.0266),
    ("ROHTAK", 28.8955, 76.6066), ("SHIMLA", 31.1048, 77.1734), ("DEHRADUN", 30.3165, 78.0322),
    ("SRINAGAR", 34.0837, 74.7973), ("JAMMU", 32.7266, 74.8570),
    ("THIRUVANANTHAPURAM", 8.5241, 76.9366), ("KOCHI", 9.9312, 76.2673), ("KOZHIKODE", 11.2588, 75.7804),
    ("THRISSUR", 10.5276, 76.2144), ("KOLLAM", 8.8932, 76.6141), ("KANNUR", 11.8745, 75.3704),
]

# FIXED VALUES: RFM segment thresholds on the summed 3..12 score.
RFM_SEGMENTS = [(10, "Champions"), (8, "Loyal"), (6, "Potential"), (4, "At Risk")]
RFM_LOWEST = "Lost"

# FIXED VALUES: Indian number units.
CRORE = 10_000_000
LAKH = 100_000
THOUSAND = 1_000
