"""Raw layouts. Every column lands as text unless the layout says otherwise; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType


def text_schema(columns: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in columns.split()])


# Source column names.
TRANSACTIONS = text_schema(
    "id date client_id card_id amount use_chip merchant_id merchant_city merchant_state zip mcc errors"
)
USERS = text_schema(
    "id current_age retirement_age birth_year birth_month gender address latitude longitude "
    "per_capita_income yearly_income total_debt credit_score num_credit_cards"
)
CARDS_FILE = text_schema(
    "id client_id card_brand card_type card_number expires cvv has_chip num_cards_issued "
    "credit_limit acct_open_date year_pin_last_changed card_on_dark_web"
)
CARDS_SENSITIVE = ("card_number", "cvv", "year_pin_last_changed")
CARDS = StructType([f for f in CARDS_FILE.fields if f.name not in CARDS_SENSITIVE])
MCC = text_schema("mcc description")
FRAUD_LABELS = text_schema("transaction_id is_fraud")
HOSPITALS = text_schema(
    "x y objectid id name address city state zip zip4 telephone type status population county "
    "countyfips country latitude longitude naics_code naics_desc source sourcedate val_method "
    "val_date website state_id alt_name st_fips owner ttl_staff beds trauma helipad"
)
BILLS_RENAMED = {
    "ID Transaksi": "id_transaksi",
    "Tanggal": "tanggal",
    "No Rekening": "no_rekening",
    "Nama Nasabah": "nama_nasabah",
    "Jenis Biller": "jenis_biller",
    "Nama Biller": "nama_biller",
    "Nomor Pelanggan": "nomor_pelanggan",
    "Nominal": "nominal",
    "Biaya Admin": "biaya_admin",
    "Total Bayar": "total_bayar",
    "Channel": "channel",
    "Status": "status",
}
BILLS_NUMBERS = ("no_rekening", "nomor_pelanggan", "nominal", "biaya_admin", "total_bayar")
BILLS_FILE = StructType([StructField(name, StringType()) for name in BILLS_RENAMED])
BILLS = StructType(
    [
        StructField(name, LongType() if name in BILLS_NUMBERS else StringType())
        for name in BILLS_RENAMED.values()
    ]
)
