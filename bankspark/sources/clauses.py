"""Contract clauses per product category.

Fixed values: the wording of the contracts, in order. Words in braces are filled in per contract.
``TABLE`` stands for the table of attributes, ``SALE_DETAILS`` for a heading shown only above a
table that has rows.
"""

TABLE = object()
SALE_DETAILS = object()

LOAN = [
    "This Loan Contract Agreement (the 'Agreement') is made and entered into as of {now}, by and between {bank} ('Lender') and {first_name} {last_name}, with an address {address} ('Borrower').",
    "1. Loan Amount: The Lender agrees to loan the Borrower the amount of {currency}{amount} (the 'Principal').",
    "2. Repayment Terms: The Borrower agrees to repay the Loan Amount with interest at a rate of {rate}% per each month of the duration of the contract, beginning on {begin} and ending on {end}. The Loan (its Principal, accrued interest, and fees) shall be repayed in full on {end}.",
    "3. Late Payment: If the repayment is not received by the Lender within 5 business days of the due date, the Borrower shall pay a late fee of 0.5% of the overdue amount (the Principal + interest + fees) for each day the amount is not paid after the first week after the due date. ",
    "4. Prepayment: The Borrower may prepay the Loan in full (its principal amount and the pro rata interest) at any time without penalty. ",
    "5. Default: The Loan shall be considered in default if the Borrower fails to make the payment one month after the due date, or if the Borrower breaches any other terms of this Agreement. In the event of default, the Lender may demand immediate repayment of the entire outstanding Loan amount, including accrued interest and fees.",
    "6. Entire Agreement: This Agreement constitutes the entire agreement between the parties and supersedes all prior understandings, agreements, representations, and warranties, both written and oral, with respect to the subject matter hereof.",
    "Product UID: {product_uid}",
    "IN WITNESS WHEREOF, the parties hereto have executed this Loan Contract Agreement as of the day and year first above written.",
    "Lender's Signature: {bank}",
    "Date: {now}",
    "Borrower's Signature: ___________________",
    "Date: _______________",
]

DERIVATIVE = [
    "This {product_name} Contract Agreement (the 'Agreement') is made and entered into as of {now}, by and between {bank} ('Issuer') and {first_name} {last_name}, with an address {address} ('Holder').",
    "The Holder agrees to buy this product with Product UID {product_uid} from the Issuer on the Product Begin Date ({begin}).",
    "If a Product UID is linked to this Product, the owner of that Product shall be deemed the counterparty to this Product. {bank} shall act as an intermediary between the two parties but shall not assume liability for the fulfillment of any party's financial obligations. In consideration of its intermediary services, {bank} shall receive a commission, as detailed below.",
    "This {product_name} shall be characterized by the following rule: {product_description}. This may be altered, augmented, or superseded by any rule hereinafter delineated.",
    "Unless as otherwise specified, the Issuer, or the substituting counterpatry, agrees that on the Product End Date ({end}) and on any of the listed observation/exercise dates, if the option condition is met, the option may be exercised.",
    TABLE,
    "IN WITNESS WHEREOF, the parties hereto have executed this Loan Contract Agreement as of the day and year first above written.",
    "Lender's Signature: {bank}",
    "Date: {now}",
    "Borrower's Signature: ___________________",
    "Date: _______________",
]

PRIVATE_EQUITY = [
    "This Partial Share Sale Agreement (\"Agreement\") is made and entered into as of {now}, by and between {first_name} {last_name}, with an address {address} (\"Acquirer\"), and {bank} (\"Seller\").",
    "RECITALS",
    "WHEREAS, Acquirer desires to acquire issued and outstanding shares of {product_name} from Seller, and Seller desires to sell such shares to Acquirer, on the terms and conditions set forth herein;",
    "NOW, THEREFORE, in consideration of the mutual covenants and promises herein contained, and for other good and valuable consideration, the receipt and sufficiency of which are hereby acknowledged, the parties hereto agree as follows:",
    "1. DEFINITIONS",
    "1.1 \"Acquisition\" means the purchase of all of the issued and outstanding shares from Seller by Acquirer as described in this Agreement.",
    "1.2 \"Closing\" means the consummation of the transactions contemplated by this Agreement.",
    "1.3 \"Closing Date\" means the date on which the Closing occurs, which shall be {end}.",
    "1.4 \"Purchase Price\" means the total consideration to be paid by Acquirer for the number shares, as specified in Section 2.1.",
    "2. PURCHASE AND SALE OF SHARES",
    "2.1 Purchase Price. The Purchase Price for the {rate}% shares of Seller shall be {currency}{amount}, payable, unless as otherwise specified, in cash.",
    "2.2 Payment of Purchase Price. The Purchase Price shall be paid by Acquirer to the Seller on or before the Closing Date.",
    "3. REPRESENTATIONS AND WARRANTIES",
    "3.1 Representations and Warranties of Seller. Seller represents and warrants to Acquirer as follows:",
    "(a) Organization and Good Standing. Seller is a corporation duly organized, validly existing, and in good standing, and has the corporate power and authority to own its properties and to carry on its business as now being conducted.",
    "(b) Authorization and Validity. Seller has the corporate power and authority to execute and deliver this Agreement and to perform its obligations hereunder.",
    "(c) No Conflicts. The execution, delivery, and performance of this Agreement by Seller do not and will not conflict with or result in any violation of or default under any provision of the organizational documents of Seller or any agreement or instrument to which Seller is a party.",
    "(d) Regulatory Compliance. Seller is in compliance in all material respects with all applicable laws, regulations, and rules governing its business.",
    "(e) Financial Statements. {product_name}'s financial statements provided to Acquirer fairly present the financial condition of Seller as of the dates indicated and have been prepared in accordance with generally accepted accounting principles (GAAP) applied on a consistent basis.",
    "(f) Client Accounts. The client accounts managed by Seller are in good standing, and there are no material disputes or claims against Seller related to its client accounts.",
    "3.2 Representations and Warranties of Acquirer. Acquirer represents and warrants to Seller as follows:",
    "(a) Authorization and Validity. Acquirer has the corporate power and authority to execute and deliver this Agreement and to perform its obligations hereunder.",
    "(b) No Conflicts. The execution, delivery, and performance of this Agreement by Acquirer do not and will not conflict with or result in any violation of or default under any provision of the organizational documents of Acquirer or any agreement or instrument to which Acquirer is a party.",
    "4. COVENANTS",
    "4.1 Conduct of Business. From the date hereof until the Closing Date, {product_name} shall conduct its business in the ordinary course and shall not engage in any material transactions outside the ordinary course of business without the prior written consent of Acquirer.",
    "4.2 Access to Information. {product_name} shall allow Acquirer and its representatives reasonable access to its properties, books, and records, and shall furnish such information concerning its business as Acquirer may reasonably request.",
    "4.3 Regulatory Approvals. The parties shall use their best efforts to obtain any necessary regulatory approvals required to consummate the transactions contemplated by this Agreement.",
    "5. CONDITIONS PRECEDENT",
    "5.1 Conditions to Obligations of Acquirer. The obligations of Acquirer to consummate the transactions contemplated by this Agreement are subject to the satisfaction of the following conditions on or before the Closing Date:",
    "(a) Accuracy of Representations and Warranties. The representations and warranties of Seller contained in this Agreement shall be true and correct in all material respects as of the Closing Date.",
    "(b) Performance of Covenants. Seller shall have performed in all material respects all covenants required to be performed by it under this Agreement on or before the Closing Date.",
    "(c) Regulatory Approvals. All necessary regulatory approvals shall have been obtained.",
    "6. TERMINATION",
    "6.1 Termination. This Agreement may be terminated at any time prior to the Closing Date:",
    "(a) by mutual written consent of Acquirer and Seller;",
    "(b) by either party if the Closing shall not have occurred on or before 7 days following the Closing Date, provided that the right to terminate this Agreement under this Section 6.1(b) shall not be available to any party whose failure to fulfill any obligation under this Agreement has been the cause of or resulted in the failure of the Closing to occur on or before such date.",
    "7. MISCELLANEOUS",
    "7.1 Notices. All notices and other communications required or permitted hereunder shall be in writing and shall be deemed given if delivered through the {bank} CRM or via email to the email address listed officially by each party.",
    "7.2 Governing Law. This Agreement shall be governed by and construed in accordance with the laws of the Republic of Bulgaria, without regard to its conflict of law principles.",
    "7.3 Entire Agreement. This Agreement constitutes the entire agreement between the parties with respect to the subject matter hereof and supersedes all prior and contemporaneous agreements and understandings, both written and oral, between the parties with respect to such subject matter.",
    "7.4 Amendment. This Agreement may be amended only by a written instrument signed by both parties.",
    "7.5 Counterparts. This Agreement may be executed in one or more counterparts, each of which shall be deemed an original but all of which together shall constitute one and the same instrument.",
    "7.6 Post-Closing Governance and Rights. Acquirer shall have the right to appoint a number of directors to the board of {product_name} as directed by its Incorporating Articles, Corporate By-Laws, and other applicable rules, representing their proportional ownership of {rate}% of the outstanding shares.",
    SALE_DETAILS,
    TABLE,
    "IN WITNESS WHEREOF, the parties hereto have caused this Agreement to be duly executed by their respective authorized officers as of the day and year first above written.",
    "Lender's Signature: {bank}",
    "Date: {now}",
    "Borrower's Signature: ___________________",
    "Date: _______________",
]

OTHER = [
    "No contract can be generated.",
    "Borrower's Signature: ___________________",
    "Date: _______________",
]

SALE_DETAILS_TEXT = "7.7 Sale Details"
STRIKE_DATE_LABEL = "Strike Date"
SIGNATURE = "Borrower's Signature: {first_name} {last_name} [digitally signed]"
SIGNATURE_DATE = "Date: {now}"

# Order of the conditions: category code, clauses. Anything else gets OTHER.
BY_CATEGORY = {"LON": LOAN, "DER": DERIVATIVE, "PEQ": PRIVATE_EQUITY}
