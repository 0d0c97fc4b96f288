"""Detection and de-identification of personal data in Traditional-Chinese (Taiwan) text, on Spark."""
